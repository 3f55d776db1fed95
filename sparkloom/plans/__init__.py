"""Selectors and their plans."""
