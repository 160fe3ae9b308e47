"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its documents in runs of about RUN_BYTES; the distinct pre-token matches of a run
that the worker's cache does not hold are one corpus. An inverted index maps the rank of a
token pair to the positions where that pair stands; ranks are taken in order, every listed
position is merged, and only the two pairs beside a merge are looked up again. A word whose
merge opens a pair of lower rank than the one in hand (possible when one token has several
splits) is set aside and merged alone, lowest rank first, leftmost first, so that every word
gets exactly the tokens that per-word merging gives. There is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kscreen.llm.common import slices, taken, trimmed
from kscreen.llm.units import UnitCache

#: Stands between words; above every id, so that a pair of ids fits in one number.
_SHIFT = 20
_GAP = (1 << _SHIFT) - 1
#: Bytes of texts whose distinct words are merged together; bounds a worker's memory.
RUN_BYTES = 8 << 20
#: Positions of one rank from which they are merged together.
MANY = 40


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes words (bytes) by ranks; replays the merges over a list of words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= _GAP:
            raise ValueError(f"ranks must be below {_GAP}")
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pair[a << _SHIFT | b] = rank
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.pair.values(), np.int64, len(keys))[order]

    def alone(self, word: bytes) -> list[int]:
        """One word: lowest rank first, leftmost first, from a heap of pairs."""
        sym, get = [self.byte[b] for b in word], self.pair.get
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(sym[i] << _SHIFT | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, p = heapq.heappop(heap)
            q = nxt[p] if sym[p] >= 0 else n
            if q >= n or get(sym[p] << _SHIFT | sym[q]) != rank:
                continue
            sym[p], sym[q], nxt[p] = rank, -1, nxt[q]
            if nxt[p] < n:
                prv[nxt[p]] = p
            for left in (prv[p], p):
                if left >= 0 and nxt[left] < n and (r := get(sym[left] << _SHIFT | sym[nxt[left]])) is not None:
                    heapq.heappush(heap, (r, left))
        return [x for x in sym if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, -1 without one."""
        pairs = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], -1)

    def _merge_all(self, rank: int, at: np.ndarray, views: tuple, odd: list[int]) -> list[tuple[int, np.ndarray]]:
        """Merge the pairs of one rank at all positions that still hold one. Returns new pairs: (rank, positions)."""
        sym, nxt, prv = views
        at = at[sym[at] >= 0]
        at = at[self._ranks(sym[at], sym[nxt[at]]) == rank]
        if not len(at):
            return []
        # of pairs that overlap, the first, third, ... of the row are merged
        chained = np.concatenate([[False], at[1:] == nxt[at[:-1]]])
        if chained.any():
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
        q = nxt[at]
        after = nxt[q]
        seen = self._ranks(np.full(len(at), rank), sym[after])  # as merging one by one would have met it
        odd.extend(at[(seen >= 0) & (seen <= rank)].tolist())
        sym[at], sym[q] = rank, -1
        nxt[at], prv[after] = after, at
        before = prv[at]
        places = np.concatenate([at, before])
        ranks = np.concatenate([self._ranks(sym[at], sym[after]), self._ranks(sym[before], sym[at])])
        early = (ranks >= 0) & (ranks <= rank)
        odd.extend(places[early].tolist())
        new = ranks > rank
        return self._grouped(places[new], ranks[new])

    @staticmethod
    def _grouped(places: np.ndarray, ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
        if not len(ranks):
            return []
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        return [(int(ranks[a]), places[a:b]) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True)]

    def index(self, symbols: np.ndarray) -> dict[int, list]:
        """Rank -> positions of the pairs that merge to it, in pieces."""
        ranks = self._ranks(symbols[:-1], symbols[1:])
        positions = np.flatnonzero(ranks >= 0)
        return {r: [at] for r, at in self._grouped(positions, ranks[positions])}

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(sizes + 1) - sizes
        joined = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        symbols = np.array(self.byte, np.int64)[joined]
        symbols[np.concatenate([[0], start + sizes])] = _GAP
        index, get = self.index(symbols), self.pair.get
        # the same memory as Python arrays, for few positions, and as numpy's, for many
        sym, nxt, prv = (array("i", x.astype(np.int32).tobytes()) for x in (symbols, np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)))
        views = tuple(np.frombuffer(x, np.int32) for x in (sym, nxt, prv))
        todo = list(index)
        heapq.heapify(todo)
        odd: list[int] = []

        def made(p: int, pair: int, rank: int) -> None:
            r = get(pair)
            if r is None:
                return
            if r <= rank:
                odd.append(p)
            elif r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(todo, r)

        while todo:
            rank = heapq.heappop(todo)
            listed = index.pop(rank)
            pieces = [x for x in listed if isinstance(x, np.ndarray)]
            at = [x for x in listed if not isinstance(x, np.ndarray)]
            if sum(map(len, pieces)) + len(at) >= MANY:
                ordered = np.sort(np.concatenate([*pieces, np.array(at, np.int64)]))
                for r, new in self._merge_all(rank, ordered[np.diff(ordered, prepend=-1) > 0], views, odd):
                    if r not in index:
                        index[r] = []
                        heapq.heappush(todo, r)
                    index[r].append(new)
                continue
            for p in sorted(at + [p for x in pieces for p in x.tolist()]):
                a = sym[p]
                if a < 0:
                    continue
                q = nxt[p]
                if get(a << _SHIFT | sym[q]) != rank:
                    continue
                after, before = nxt[q], prv[p]
                sym[p], sym[q] = rank, -1
                nxt[p] = after
                prv[after] = p
                made(p, rank << _SHIFT | sym[after], rank)
                made(before, sym[before] << _SHIFT | rank, rank)
        final = views[0]
        live = final >= 0
        live[np.concatenate([[0], start + sizes])] = False
        ends = np.cumsum(live)
        ids = final[live].tolist()
        out = [ids[a:b] for a, b in zip((ends[start - 1]).tolist(), ends[start + sizes].tolist(), strict=True)]
        for k in set((np.searchsorted(start, odd, "right") - 1).tolist()):
            out[k] = self.alone(words[k])
        return out


_LOADED: dict[tuple[str, str], UnitCache] = {}


def _cache(path: str, pattern: str) -> UnitCache:
    """One per Python worker and vocabulary."""
    if (path, pattern) not in _LOADED:
        replay, find = MergeReplay(load_ranks(path)), regex.compile(pattern).findall

        def encode_new(units: list[bytes]) -> list[bytes]:
            split = [find(u.decode()) for u in units]
            words = list(dict.fromkeys(w for ws in split for w in ws))
            ids = {w: array("i", x).tobytes() for w, x in zip(words, replay.replay([w.encode() for w in words]), strict=True)}
            return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in split]

        _LOADED[path, pattern] = UnitCache(encode_new)
    return _LOADED[path, pattern]


def _encoded(batches: Iterator[pa.RecordBatch], cache: UnitCache) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """batches: (id, text). (ids of some rows, token ids of all of them, where each row's begin and end)."""
    for batch in batches:
        for part in slices(batch, 1, RUN_BYTES):
            codes, ends = cache.encode(part.column(1))
            yield part.column(0), np.frombuffer(codes or b"", np.int32), ends // 4


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return taken(docs, id=id_col, text=text_col).select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (id_col, ids array<int>).

    Null and empty texts have no tokens. Rows are coded one by one: ties do not exist, and repeated
    rows and null ids are encoded like others; an empty table gives an empty one; other columns are
    not carried, whatever their names. Very long texts are cut into units before they are coded; a
    worker holds one of them and its ids. pattern must be of the family named in ``units``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, ends in _encoded(batches, _cache(ranks_path, pattern)):
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens[: ends[-1]]))], [id_col, "ids"])

    rows = _texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(trimmed(run), schema)


class Decoder:
    """The bytes that ids stand for."""

    def __init__(self, ranks: dict[bytes, int]):
        token = {i: t for t, i in ranks.items()}
        self.tokens = pa.array([token.get(i) for i in range(max(token) + 1)], pa.binary())

    def bytes(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """The bytes of each of the rows whose ids begin and end at ends. An id without a token raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id has no token")
        return _gathered(self.tokens, ids, ends)


def _gathered(table: pa.BinaryArray, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The entries of ids in a row, a piece for each row."""
    out = table.take(pa.array(ids, pa.int32()))
    if out.null_count:
        raise ValueError("an id has no token")
    at = np.frombuffer(out.buffers()[1], np.int32)[ends].tolist() if len(out) else [0] * len(ends)
    data = memoryview(out.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(at, at[1:])]


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with one more column, out_col: the bytes that its ids stand for (empty for null or no ids).

    An id without a token raises, and so does an out_col that df has already.
    """
    if out_col in df.columns:
        raise ValueError(f"there is a column {out_col} already")
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_ranks(ranks_path))
        for batch in batches:
            lists = batch.column(at)
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = decoder.bytes(lists.flatten().to_numpy(zero_copy_only=False), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): every text is encoded and its ids decoded again,
    in one pass; cases as in ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_ranks(ranks_path))
        decimal = pa.array([f"{i} ".encode() for i in range(len(decoder.tokens))], pa.binary())
        sha: Callable[[memoryview], str] = lambda x: hashlib.sha256(x).hexdigest()
        for ids, tokens, ends in _encoded(batches, _cache(ranks_path, pattern)):
            columns = [
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array([sha(x[:-1]) for x in _gathered(decimal, tokens, ends)], pa.string()),
                pa.array([sha(x) for x in decoder.bytes(tokens, ends)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([ids, *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = _texts(docs, id_col, text_col)
    names = (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))
    return rows.mapInArrow(trimmed(run), T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *[T.StructField(*n) for n in names]]))
