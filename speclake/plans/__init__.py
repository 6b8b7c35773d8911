"""Registered queries: operators over stand-in views of the given tables, with the same in SQL."""
