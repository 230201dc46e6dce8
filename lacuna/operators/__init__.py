"""Relational operators over many cases at once."""
