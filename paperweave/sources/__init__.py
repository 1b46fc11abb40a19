"""Readers and writers of the record formats."""
