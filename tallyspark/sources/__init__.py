"""Schemas, tables and files."""
