"""Relational operators over summary-statistics tables."""
