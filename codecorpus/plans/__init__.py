"""Registered queries over the shared tables, and their checks in SQL."""
