"""Registered queries over the shared tables, with the SQL each one is checked against."""
