"""Registered queries over the star tables, and end-to-end runs."""
