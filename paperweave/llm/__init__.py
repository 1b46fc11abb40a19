"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
