"""Registered queries and the SQL beside them."""
