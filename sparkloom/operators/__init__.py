"""Operators over documents and over node tables."""
