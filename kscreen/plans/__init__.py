"""Whole queries and the command line."""
