"""Expressions: statistics of columns and conversions of values."""
