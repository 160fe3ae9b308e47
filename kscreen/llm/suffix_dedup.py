"""Removal of repeated byte strings by suffix arrays built by two-stage sorting.

Candidate strings come from ``repeats`` (equal 400-byte windows always share a minimiser). The
strings of a bucket are joined and their suffix array is built in two stages: only suffixes
smaller than their successors are sorted directly, eight bytes at a time; the others are induced
by scanning the first-byte buckets in order. Adjacent common prefixes of the array then show
which windows are equal. Order beyond the window's length does not matter and is not sought.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kscreen.llm.common import taken
from kscreen.llm.repeats import Spec, byte_grams, covered, finished

WINDOW, GRAM = 400, 48
#: Bytes that tied suffixes go on by where all of a tie share them.
BLOCK = 64


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Positions of text ordered by their next depth bytes (at least; the end sorts before any byte)."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(text, np.uint8)
    step = np.concatenate([np.sign(raw[1:].astype(np.int16) - raw[:-1]), [-1]])
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n), n - 1)[::-1])[::-1]
    smaller = step[nearest] > 0  # than the successor
    direct = _sorted_direct(text, np.flatnonzero(smaller), depth)
    ends = np.concatenate([[0], np.cumsum(np.bincount(raw[direct], minlength=256))])
    # second stage: scan the buckets of first bytes in order; what a suffix induces is its predecessor
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[raw[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        done = []
        while len(front):
            done.append(front)
            before = front[front > 0] - 1
            front = before[raw[before] == c]
        bucket = np.concatenate([*done, direct[ends[c] : ends[c + 1]]]) if done else direct[ends[c] : ends[c + 1]]
        induced[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        chars = raw[before]
        above = chars > c
        before, chars = before[above], chars[above]
        order = np.argsort(chars, kind="stable")
        before, cuts = before[order], np.flatnonzero(np.diff(chars[order])) + 1
        if len(before):
            for part in np.split(before, cuts):
                induced[raw[part[0]]].append(part)
    return np.concatenate(out)


def _words_at(text: bytes, depth: int) -> np.ndarray:
    """The eight bytes from every position as an unaligned big-endian view; zeros follow the end."""
    padded = text + bytes(depth + 16)
    return np.ndarray((len(text) + depth + 8,), ">u8", padded, strides=(1,))


def _sorted_direct(text: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their next depth bytes: most significant eight bytes first, ties onward.

    Suffixes that are tied go on by BLOCK bytes at once where these are the same for the whole tie,
    as a hash of them tells; else by eight bytes.
    """
    if not len(at):
        return at
    words = _words_at(text, depth)
    blocks = byte_grams(text + bytes(depth + BLOCK + 16), BLOCK)
    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    slots = np.arange(len(at))
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    done = np.full(len(at), 8)  # bytes that the members of a slot's tie share
    while True:
        size = np.bincount(group)
        open_ = (size[group] > 1) & (done < depth)
        if not open_.any():
            return at
        slots, group, done = slots[open_], group[open_], done[open_]
        same = group[1:] == group[:-1]
        group = np.concatenate([[0], np.cumsum(~same)])
        place = at[slots] + done
        block = blocks[place]
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][same & (block[1:] != block[:-1])]] = True
        part = np.flatnonzero(mixed[group])
        done = np.where(mixed[group], done + 8, done + BLOCK)
        if len(part):
            key = np.zeros(len(group), np.uint64)
            key[part] = words[place[part]].astype(np.uint64)
            order = np.lexsort((key[part], group[part]))
            at[slots[part]] = at[slots[part[order]]]
            key[part] = key[part[order]]
            group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (key[1:] != key[:-1]))])


def shared_prefix(text: bytes, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the common prefix of each pair of suffixes reaches depth bytes; the end of text is no byte."""
    n = len(text)
    inside = np.maximum(a, b) + depth <= n
    first = byte_grams(text, 8) if n >= 8 and depth >= 8 else None
    if first is not None:  # most pairs differ early
        near = np.flatnonzero(inside)
        inside[near] = (first[a[near]] == first[b[near]]) & (first[a[near] + depth - 8] == first[b[near] + depth - 8])
    near = np.flatnonzero(inside)
    inside[near] = [text[x : x + depth] == text[y : y + depth] for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True)]
    return inside


def compare(strings: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its first counts[i] windows occur twice or more in all strings."""
    text = b"\0".join(strings)
    sizes = np.array([len(s) for s in strings]) + 1
    base = np.cumsum(sizes) - sizes
    owner = np.full(len(text) + 1, -1, np.int64)
    for i, (a, n) in enumerate(zip(base.tolist(), counts.tolist(), strict=True)):
        owner[a : a + n] = i
    order = suffix_array(text, window)
    order = order[owner[order] >= 0]
    flags = np.zeros(len(text) + 1, bool)
    if len(order):
        new = np.concatenate([[True], ~shared_prefix(text, order[:-1], order[1:], window)])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(order)))
        flags[order] = np.repeat(size > 1, size)
    return [flags[a : a + n] for a, n in zip(base.tolist(), counts.tolist(), strict=True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, kept binary, n_bytes, n_removed, n_spans) of every row.

    Every byte covered by a window-byte string that also starts anywhere else goes, its first
    occurrence included. Null texts count as empty; texts shorter than the window lose nothing;
    repeated rows and rows that share an id repeat each other's strings, so all lose them; null
    ids are ids like others; strings of equal minimiser hash are told apart by their bytes; an
    empty table gives an empty one; other columns are not read, whatever their names. A worker
    holds one very long text, and minimisers of a piece of it.
    """

    def finish(part: pa.RecordBatch, marks: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        out = [_kept(t, first, n, window) for t, (first, n) in zip(part.column(1).to_pylist(), marks, strict=True)]
        kept, *counts = zip(*out, strict=True)
        return [pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in counts]]

    names = ("n_bytes", "n_removed", "n_spans")
    added = T.StructType([T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in names]])
    rows = taken(docs, id=id_col, text=text_col)
    return finished(rows, Spec(window, GRAM, False), compare, "id", "text", finish, added).select(F.col("id").alias(id_col), "kept", *names)


def _kept(text: str | None, first: np.ndarray, n: np.ndarray, window: int) -> tuple[bytes, int, int, int]:
    data = (text or "").encode()
    if not len(first):
        return data, len(data), 0, 0
    gone = covered(first, n, len(data), window)
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[str, int, int, int]]:
    """(kept_sha256, n_bytes, n_removed, n_spans) of each text by a dictionary of all windows; for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - window + 1):
            seen[d[i : i + window]] = seen.get(d[i : i + window], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest(), len(d), int(gone.sum()), runs))
    return out
