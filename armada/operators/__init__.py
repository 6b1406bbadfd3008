"""Joins, aggregates, windows and set operations over fleet tables."""
