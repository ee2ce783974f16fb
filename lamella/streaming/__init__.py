"""Rows that arrive over time."""
