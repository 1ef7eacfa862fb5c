"""Joins, aggregations, windows and statistics over the canonical tables."""
