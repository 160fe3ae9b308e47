"""Screening of sequences and texts against reference sets, as DataFrame operations."""
