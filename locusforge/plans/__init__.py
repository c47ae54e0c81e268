"""Derived tables and the catalogue of queries with their SQL."""
