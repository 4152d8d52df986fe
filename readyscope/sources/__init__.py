"""Readers and writers, and the column mapping onto the retail tables."""
