"""Readers and writers: delimited files, VCF, stores, panels."""
