"""Queries that show each operator on the supplied tables, with their SQL."""
