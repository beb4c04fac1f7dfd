"""Operators on facts, space, records and graphs."""
