"""locusforge: a PySpark-native engine for genetic association summary statistics."""

__version__ = "0.1.0"
