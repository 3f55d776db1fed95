"""What happens to one document, in plain Python without Spark."""
