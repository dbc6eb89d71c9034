"""Queries over the given tables, with the SQL they are checked against.

Captures are encoded from the tables and decoded by the operators; the SQL reads the tables
directly, so the two ways meet only in their result.
"""
