"""Operators for large text corpora and numeric columns; nothing else in the library imports this."""
