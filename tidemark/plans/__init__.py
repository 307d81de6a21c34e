"""Registered queries over the driver tables, and SQL that says the same."""
