"""Relational operators: index, search, dedup, classification, ingest."""
