"""Registered queries over the star-schema tables, and the same results as plain SQL."""
