"""Column functions and scalar rules."""
