"""Queries that bind the operators to the driver tables, with their SQL."""
