"""Shared odd cases."""

#: Null, empty, blank, one word, white space of other kinds, and texts that repeat.
ODD_TEXTS = [None, "", " ", "\n\t", "word", "word", "  a  b ", "a b", "x" * 5000, "x" * 5000, "é" * 300, "\x00\x01"]
