"""Training-data operators: quality, PII, language, tokens, decontamination, secrets, archives, near-duplicates.

Nothing else in the package imports this subpackage.
"""
