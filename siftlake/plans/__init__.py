"""Registered queries: one per operator, with the SQL that describes the same result."""
