"""Registered queries, their SQL twins, and run-time helpers."""
