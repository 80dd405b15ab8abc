"""Composite queries, their registry and their SQL."""
