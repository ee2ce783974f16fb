"""Operators on tables: nesting, writing, routing, appending and merging."""
