"""Operators for preparing training corpora; queries() and oracle_sql() are in registry.py."""
