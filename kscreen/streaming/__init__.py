"""Screening of streams."""
