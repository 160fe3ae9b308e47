"""Benchmark decontamination by pigeonhole edit matching.

A test item with a budget of e edits is split into e + 1 pieces: wherever the item stands in a
text with at most e edits, at least one piece stands there unchanged. An automaton finds all
exact piece hits of a block of items in one pass over each whole text; every hit's surrounding
is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kscreen.llm.common import by_place, taken, trimmed, unused

#: Edits allowed for each hundred characters of an item, and the least length of a piece.
EDITS_PERCENT, PIECE = 5, 14
#: Characters of items that are shipped to tasks at once; more items are taken in further blocks.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return max(0, min(len(item) * EDITS_PERCENT // 100, len(item) // PIECE - 1))


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def distance(item: str, text: str) -> int:
    """The least edit distance between item and any substring of text."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << m - 1
    equal: dict[str, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score = mask, 0, m
    best = m
    for c in text:
        eq = equal.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & mask
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1 & mask, mh << 1 & mask
        plus, minus = (mh | ~(xv | ph)) & mask, ph & xv
    return best


class Matcher:
    """A block of (id, normalised item)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            for at, piece in pieces(item):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def match(self, text: str) -> dict[int, int]:
        """Index of each item that stands in the normalised text within its budget -> least distance."""
        starts: dict[int, set[int]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for k, at in found:
                starts.setdefault(k, set()).add(end - size + 1 - at)
        out = {}
        for k, offsets in starts.items():
            item = self.items[k][1]
            e = budget(item)
            least = e + 1
            for a, b in _merged(sorted(offsets), 2 * e):
                least = min(least, distance(item, text[max(0, a - e) : b + len(item) + e]))
                if not least:
                    break
            if least <= e:
                out[k] = least
        return out


def _merged(offsets: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """(first, last) of offsets that lie within gap of their neighbours."""
    first = last = offsets[0]
    for x in offsets[1:]:
        if x - last > gap:
            yield first, last
            first = x
        last = x
    yield first, last


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, in blocks of about BLOCK_CHARS characters; items without text are left out."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in taken(benchmark, id=id_col, text=text_col).select(F.col("id").cast("long"), "text").toLocalIterator():
        item = normal(r.text)
        if item:
            block.append((r.id, item))
            size += len(item)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", out_col: str = "_found") -> DataFrame:
    """docs with one more column, out_col: array<struct<item_id, distance>>, empty for clean rows.

    Null and empty texts are clean; an item with a null id is reported with a null id; equal items
    are all reported, as are items that stand in the same place; repeated rows are judged alike;
    an empty table gives an empty one, an empty benchmark leaves all rows clean. Very long texts
    are matched whole, one at a time. docs may have any other columns; one of out_col's name, in
    any case, raises. Rows are neither shuffled nor collected: each block of items is one more
    pass within the same task.
    """
    if unused(docs, out_col) != [out_col]:
        raise ValueError(f"docs has a column {out_col} already")
    found = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))
    out = by_place(docs).withColumn("found", F.array().cast(found))
    schema = out.schema
    text_at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_id_col, item_text_col):
        out = out.mapInArrow(trimmed(_pass(block, text_at)), schema)
    return out.toDF(*docs.columns, out_col)


def _pass(block: list[tuple[int, str]], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block)
        for b in batches:
            *rest, before = b.columns
            texts, old = b.column(text_at), before.to_pylist()
            for i in range(b.num_rows):
                hits = matcher.match(normal(texts[i].as_py()))
                if hits:
                    old[i] = old[i] + [{"item_id": block[k][0], "distance": d} for k, d in hits.items()]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(old, kind)], b.schema.names)

    return run


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, contaminated, n_items, item_ids sorted, min_distance) of every row; cases as in ``matches``."""
    out = matches(taken(docs, id=id_col, text=text_col), benchmark)
    return out.select(
        F.col("id").alias(id_col),
        (F.size("_found") > 0).alias("contaminated"),
        F.size("_found").alias("n_items"),
        F.array_sort(F.transform("_found", lambda x: x["item_id"])).alias("item_ids"),
        F.array_min(F.transform("_found", lambda x: x["distance"])).alias("min_distance"),
    )


def brute_force(text: str | None, items: list[tuple[int, str | None]]) -> list[tuple[int, int]]:
    """(id, distance) of the items within their budgets, by the plain dynamic programme; for tests."""
    out = []
    t = normal(text)
    for k, raw in items:
        item = normal(raw)
        if not item:
            continue
        row = list(range(len(item) + 1))
        best = row[-1]
        for c in t:
            last, row[0] = row[0], 0
            for i, x in enumerate(item, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
            best = min(best, row[-1])
        if best <= budget(item):
            out.append((k, best))
    return out
