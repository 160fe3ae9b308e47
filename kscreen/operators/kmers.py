"""Tiles, k-mers and anchors as columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kscreen.functions.text import ascii_lower


#: Characters of the pieces that long texts are cut into.
PIECE = 256


def tile_array(s: Column, size: int) -> Column:
    """Consecutive pieces of size characters, the last one shorter. One pass over the text, where
    substr by position would be quadratic on long texts."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def tiles(df: DataFrame, text_col: str, size: int, *keep: str) -> DataFrame:
    """(keep..., tile_no from 0, seq lower-cased): the analogue of short reads. Null and empty texts have none."""
    return df.select(*keep, F.posexplode(tile_array(ascii_lower(F.col(text_col)), size)).alias("tile_no", "seq"))


def kmer_array(s: Column, k: int) -> Column:
    """All k-mers of a short text in a plain column (a tile, a read); none for texts below k.

    The work grows with the square of the text's length; see ``windows`` for texts of any length.
    """
    n = F.length(s)
    found = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    return F.when(n >= k, found).otherwise(F.array().cast("array<string>"))


def anchor_starts(n: Column, k: int) -> Column:
    """0-based starts 0, k, 2k, ... and n - k; none for texts below k."""
    every = F.sequence(F.lit(0), n - k, F.lit(k))
    return F.when(n >= k, F.array_union(every, F.array(n - k))).otherwise(F.array().cast("array<int>"))


def windows(df: DataFrame, s: Column, k: int, *keep: str) -> DataFrame:
    """(keep..., pos from 0, kmer) of every k-mer of s, of any length; none for texts below k.

    A text is cut in one pass into pieces that go on for k - 1 characters into the next one; the
    pieces become rows before they are cut further, so the work grows with the text's length.
    """
    size = max(PIECE, k)
    parts = tile_array(s, size)
    pairs = F.arrays_zip(parts.alias("own"), F.slice(parts, F.lit(2), F.size(parts)).alias("next"))
    ahead = F.transform(pairs, lambda z, i: F.struct((i.cast("long") * size).alias("at"), F.concat(z["own"], F.coalesce(F.substring(z["next"], 1, k - 1), F.lit(""))).alias("s")))
    rows = df.select(*keep, F.explode(ahead).alias("_w")).select(*keep, F.col("_w.at").alias("_at"), F.col("_w.s").alias("_s"))
    rows = rows.select(*keep, "_at", F.posexplode(kmer_array(F.col("_s"), k)).alias("_i", "kmer"))
    return rows.select(*keep, (F.col("_at") + F.col("_i")).alias("pos"), "kmer")


def kmers(df: DataFrame, text_col: str, k: int, *keep: str) -> DataFrame:
    """(keep..., kmer): every k-mer, lower-cased, windows over line breaks included once breaks are stripped by the reader."""
    return windows(df, ascii_lower(F.col(text_col)), k, *keep).select(*keep, "kmer")


def kmer_set(df: DataFrame, text_col: str, k: int, *keep: str) -> DataFrame:
    """The distinct k-mers (per keep)."""
    return kmers(df, text_col, k, *keep).distinct()


def anchors(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """(keep..., pos, kmer) of the anchors of lower-cased reads in seq."""
    rows = reads.select(*keep, "seq", F.explode(anchor_starts(F.length("seq"), k)).alias("pos"))
    return rows.select(*keep, "pos", F.substring(F.col("seq"), F.col("pos") + 1, F.lit(k)).alias("kmer"))
