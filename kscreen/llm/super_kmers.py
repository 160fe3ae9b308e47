"""Removal of repeated word windows by super-k-mer partitioning.

Consecutive 35-word windows that share a minimiser travel as one packed string to that
minimiser's bucket (``repeats``); there the windows are counted exactly by sorting: ranks of
single words are doubled to ranks of 2, 4, 8, ... words, each time by sorting pairs of ranks,
until a rank stands for a whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kscreen.llm.common import taken, unused
from kscreen.llm.repeats import Spec, covered, finished

WINDOW, GRAM = 35, 8


def window_ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal windows of ids, from every position that has a whole window."""
    rank, width = ids.astype(np.uint64), 1
    while width < window and len(rank):
        ahead = min(width, window - width)
        rank = np.unique(rank[:-ahead] << np.uint64(32) | rank[ahead:], return_inverse=True)[1].astype(np.uint64)
        width += ahead
    return rank


def compare(strings: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its first counts[i] windows occur twice or more in all strings."""
    number: dict[bytes, int] = {}
    parts = [s.split(b" ") for s in strings]
    ids = np.array([number.setdefault(w, len(number)) for p in parts for w in p], np.uint64)
    ranks = window_ranks(ids, window)
    sizes = np.array([len(p) for p in parts])
    base = np.cumsum(sizes) - sizes
    at = np.concatenate([np.arange(a, a + n) for a, n in zip(base, counts, strict=True)]) if len(base) else np.zeros(0, np.int64)
    own = ranks[at]
    total = np.bincount(own.astype(np.int64))
    flags = total[own.astype(np.int64)] > 1
    return np.split(flags, np.cumsum(counts)[:-1])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, kept binary, n_words, n_removed) of every row; kept joins the kept words by one space.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Every word covered by a
    window whose words also start anywhere else goes, its first occurrence included. Null texts
    count as empty; texts shorter than the window lose nothing; repeated rows and rows that share
    an id repeat each other's windows, so all lose them; null ids are ids like others; windows of
    equal minimiser hash are told apart by their words; an empty table gives an empty one; other
    columns are not read, whatever their names. Of a very long text a worker holds the text, its
    words and 16 bytes a word; hashes are taken in pieces.
    """
    rows = taken(docs, id=id_col, text=text_col)
    return with_kept(rows, "text", "id", window, ("kept", "n_words", "n_removed")).select(F.col("id").alias(id_col), "kept", "n_words", "n_removed")


def with_kept(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, names: tuple[str, str, str] = ("_kept", "_n_words", "_n_removed")
) -> DataFrame:
    """docs with three more columns of these names: kept, n_words and n_removed as in ``remove_repeats``.

    The cases are as there; all rows and columns of docs stay as they are. A name that docs has
    already, in any case, raises.
    """
    if unused(docs, *names) != list(names):
        raise ValueError(f"docs has a column of {names} already")

    def finish(part: pa.RecordBatch, marks: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        out = [_kept(t, first, n, window) for t, (first, n) in zip(part.column(at).to_pylist(), marks, strict=True)]
        kept, n_words, n_removed = zip(*out, strict=True)
        return [pa.array(kept, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]

    at = docs.columns.index(text_col)
    added = T.StructType([T.StructField(n, k) for n, k in zip(names, (T.BinaryType(), T.LongType(), T.LongType()), strict=True)])
    return finished(docs, Spec(window, GRAM, True), compare, id_col, text_col, finish, added)


def _kept(text: str | None, first: np.ndarray, n: np.ndarray, window: int) -> tuple[bytes, int, int]:
    words = (text or "").encode().split()
    if not len(first):
        return b" ".join(words), len(words), 0
    gone = covered(first, n, len(words), window)
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), len(words), int(gone.sum())


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[str, int, int]]:
    """(kept_sha256, n_words, n_removed) of each text by a dictionary of all windows; for tests."""
    docs = [(t or "").encode().split() for t in texts]
    seen: dict[tuple[bytes, ...], int] = {}
    for d in docs:
        for i in range(len(d) - window + 1):
            seen[tuple(d[i : i + window])] = seen.get(tuple(d[i : i + window]), 0) + 1
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((hashlib.sha256(b" ".join([w for w, g in zip(d, gone, strict=True) if not g])).hexdigest(), len(d), sum(gone)))
    return out
