"""Readers and writers beyond the built-in formats."""
