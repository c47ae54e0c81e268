"""Scalar column functions: assemblies, identities, statistics."""
