"""Relational operators of the screening engine."""
