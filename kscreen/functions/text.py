"""String functions on columns. All are built in, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"


def ascii_lower(s: Column) -> Column:
    """A-Z folded; other characters are untouched, so both engines and every locale agree."""
    return F.translate(s, UPPER, LOWER)


def revcomp(s: Column) -> Column:
    """Reversed, with A-T and C-G swapped in either case; other characters stay."""
    return F.translate(F.reverse(s), BASES, COMPLEMENTS)


def strip_newlines(s: Column, carriage_returns: bool = False) -> Column:
    """Line feeds go; carriage returns too where a reference is read, but not in reads."""
    return F.translate(s, "\r\n" if carriage_returns else "\n", "")


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_replace(path, r"^.*[\\/]", "")


def stem(path: Column) -> Column:
    """The basename without its last extension (of x.fastq.gz: x.fastq)."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def last_index(s: Column, part: str) -> Column:
    """1-based place of the last occurrence, 0 without one."""
    at = F.instr(F.reverse(s), part[::-1])
    return F.when(at > 0, F.length(s) - at - len(part) + 2).otherwise(F.lit(0))


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 with milliseconds and offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSZ")


def count_of(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))
