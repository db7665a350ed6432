"""Registered queries by topic: each a DataFrame and the SQL that says the same."""
