"""Operators on event and rollup tables."""
