"""Windows that occur more than once in a corpus, found through minimisers.

A window is W consecutive units (bytes or words) of one text. Every window is named by its
minimiser: the leftmost of its k-unit grams with the least hash. Consecutive windows with the
same minimiser form a run, and a run's text travels as one packed string (a super-k-mer).
Equal windows have equal minimisers, so windows are only ever compared within a minimiser:

1. minimisers are counted over the whole corpus, summed in each task before they are shuffled;
   those that occur twice or more make a bit table in the shared folder (``bitfilter``: bounded,
   and at any size it only decides how much travels in vain, never the result);
2. runs that pass it are listed by a 128-bit digest of their string, equal ones of a text as
   one; a string that occurs twice has only repeated windows;
3. of the strings that share a minimiser with a different string, one copy each travels to the
   minimiser's bucket, where their windows are compared exactly. A minimiser with more than HOT
   strings is split instead: its windows are counted by 128-bit digests. Tasks merge what they
   have of a digest and pack the rest into one block for each of a number of buckets that grows
   with the windows, so that no task gets all of a minimiser or of a window;
4. the spans come back to their rows as ranges; only texts that have any are shuffled for it.

Texts are taken by slices of a batch that are bounded in bytes, never as a whole batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kscreen.llm.bitfilter import BitFilter
from kscreen.llm.common import by_place, read_back, remove, row_key, slices, store, trimmed

#: Distinct strings of one minimiser above which its windows are counted by digests.
HOT = 512
#: Windows of hot minimisers that a task packs at once, and that a bucket of digests has about.
PACK = 1 << 18
#: Bytes of packed strings that a bucket task compares at once (whole minimisers).
CHUNK_BYTES = 1 << 20
_POS = np.uint64((1 << 24) - 1)
#: Units of a text whose minimisers are found at once.
SEGMENT = 1 << 20
#: Bytes of a text whose words are hashed at once (one word at least).
PIECE = 1 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_R = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h *= _M3
    h ^= h >> np.uint64(29)
    return h


def byte_grams(data: bytes, k: int) -> np.ndarray:
    """Hash of the k bytes (a multiple of 8) from every position."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = words[:n] * _M1
    for i in range(8, k, 8):
        h ^= h >> np.uint64(31)
        h += words[i : i + n]
        h *= _M2
    return mix(h)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    size = 1 << max(16, n.bit_length())
    held = max(_POWERS, default=0)
    if size > held:
        pair = []
        for r in (_R, pow(_R, -1, 1 << 64)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = (pair[0], pair[1])
        held = size
    return _POWERS[held]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word; words are runs of bytes other than 0x20 and 0x09-0x0D.

    Long texts are taken in pieces of about PIECE bytes that end between words.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= PIECE:
        return _word_hashes(raw)
    out, a = [], 0
    while a < len(raw):
        b, step = a + PIECE, PIECE
        while b < len(raw) and not _SPACE[raw[b]]:  # on to the next white space
            space = np.flatnonzero(_SPACE[raw[b : b + step]])
            b, step = (b + int(space[0]) if len(space) else b + step), 2 * step
        out.append(_word_hashes(raw[a:b]))
        a = b
    return np.concatenate(out)


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_grams(data: bytes, k: int) -> np.ndarray:
    """Hash of the k words from every word."""
    h = word_hashes(data)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _M1 + h[i : i + n]
    return mix(out)


def runs(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each run; a window has width grams."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > SEGMENT:
        parts = [(a, runs(grams[a : a + SEGMENT + width - 1], width)) for a in range(0, n, SEGMENT)]
        return tuple(np.concatenate([p[1][i] + (p[0] if i == 0 else 0) if i < 2 else p[1][i] for p in parts]) for i in range(3))  # type: ignore[return-value]
    size = -(-len(grams) // width) * width
    keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    keys[: len(grams)] = grams & ~_POS | np.arange(len(grams), dtype=np.uint64)
    table = keys.reshape(-1, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & _POS).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.diff(np.append(first, n)), grams[at[first]]


@dataclass(frozen=True)
class Spec:
    """window: units of a window; gram: units of a minimiser; words: units are words, else bytes."""

    window: int
    gram: int
    words: bool

    def runs(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) < self.window:
            return runs(np.zeros(0, np.uint64), 1)
        return runs(word_grams(data, self.gram) if self.words else byte_grams(data, self.gram), self.window - self.gram + 1)

    def strings(self, data: bytes, first: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The packed string of each run: all its windows' units."""
        if self.words:
            units = data.split()
            return [b" ".join(units[a : a + n + self.window - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
        return [data[a : a + n + self.window - 1] for a, n in zip(first.tolist(), count.tolist(), strict=True)]

    def windows(self, string: bytes, count: int) -> list[bytes]:
        """The windows of a packed string."""
        if self.words:
            units = string.split(b" ")
            return [b" ".join(units[a : a + self.window]) for a in range(count)]
        return [string[a : a + self.window] for a in range(count)]


#: Bucket comparison: (strings, windows in each, window) -> which windows of each string occur twice or more.
Compare = Callable[[list[bytes], np.ndarray, int], list[np.ndarray]]


def _data(x: str | bytes | None) -> bytes:
    return b"" if x is None else x if isinstance(x, bytes) else x.encode()


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))


def _spot(k2: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key of a run: its row's and its place's."""
    return k2 ^ first ^ first << 31


def _spot_column(k2: Column, first: Column) -> Column:
    return k2.bitwiseXOR(first).bitwiseXOR(F.shiftleft(first, 31))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(k1, k2, text as bytes) of each row of a batch of (k1, k2, text)."""
    for part in slices(batch, 2):
        for k1, k2, t in zip(*[c.to_pylist() for c in part.columns], strict=True):
            yield k1, k2, _data(t)


def spans(rows: DataFrame, spec: Spec, compare: Compare) -> DataFrame:
    """rows: (k1, k2, text). Returns (k1, k2, spans array<struct<first, n>>): runs of repeated windows' starts."""
    spark = rows.sparkSession
    done: list[str] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        done.append(store(df, tag))
        return read_back(df, done[-1])

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                a = spec.runs(_data(t.as_py()))[2]
                held.append(a)
                size += len(a)
                if size >= 1 << 20:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    anchors = rows.select("text").mapInArrow(trimmed(count_anchors), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = keep(anchors.filter("n > 1").select("anchor"), "anchors")
    shared = BitFilter(repeated, "anchor", repeated.count())
    done.append(shared.path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for k1, k2, data in _rows(b):
                first, count, anchor = spec.runs(data)
                if not len(first):
                    continue
                ok = shared.passes(anchor)
                first, count, anchor = first[ok], count[ok], anchor[ok].view(np.int64).tolist()
                own: dict[tuple[int, bytes], list] = {}
                for a, n, h, s in zip(first.tolist(), count.tolist(), anchor, spec.strings(data, first, count), strict=True):
                    d = xxhash.xxh3_128_digest(s)
                    if (h, d) in own:
                        own[h, d][6].append(a)
                    else:
                        own[h, d] = [k1, k2, a, n, h, d, []]
                out += own.values()
                if len(out) >= 20_000:
                    yield _batch(out, RUN)
                    out = []
        if out:
            yield _batch(out, RUN)

    found = keep(rows.select("k1", "k2", "text").mapInArrow(trimmed(listed), "k1 long, k2 long, first long, n long, anchor long, digest binary, more array<long>"), "runs")
    weight = F.size("more") + 1
    strings = found.groupBy("anchor", "digest").agg(F.sum(weight).alias("weight"), F.min(F.struct("k1", "k2", "first")).alias("at"))
    strings = keep(strings.select("anchor", "digest", "weight", F.col("at.k2").alias("k2"), _spot_column(F.col("at.k2"), F.col("at.first")).alias("spot")), "strings")
    kinds = keep(strings.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    # both sides of these joins are plain scans, so that a key of very many rows can be split by the engine
    twice = strings.filter("weight > 1").select("anchor", "digest")
    alone = found.filter(F.size("more") == 0).select("anchor", "digest", "k1", "k2", "first", "n").join(twice, ["anchor", "digest"]).select("k1", "k2", "first", "n")
    inside = found.filter(F.size("more") > 0).select("k1", "k2", F.explode(F.concat(F.array("first"), "more")).alias("first"), "n")
    open_ = keep(strings.select("anchor", "k2", "spot").join(kinds.select("anchor"), "anchor").select("k2", "spot"), "open")
    wanted = BitFilter(open_, "spot", open_.count())
    asked = BitFilter(open_, "k2", open_.select("k2").distinct().count())
    hot = keep(kinds.filter(F.col("kinds") > HOT).select("anchor"), "hot")
    split = BitFilter(hot, "anchor", n_hot := hot.count())
    done.extend((wanted.path, asked.path, split.path))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of wanted runs. By chance a few more come, which are strings of the corpus too."""
        out: list[tuple] = []
        size = 0
        for b in batches:
            b = b.filter(pa.array(asked.passes(b.column(1).to_numpy()))) if b.num_rows else b
            for k1, k2, data in _rows(b):
                first, count, anchor = spec.runs(data)
                if not len(first):
                    continue
                ok = shared.passes(anchor) & wanted.passes(_spot(np.int64(k2), first))
                if not ok.any():
                    continue
                first, count, anchor = first[ok], count[ok], anchor[ok]
                is_hot = split.passes(anchor).tolist()
                for a, n, h, s, x in zip(first.tolist(), count.tolist(), anchor.view(np.int64).tolist(), spec.strings(data, first, count), is_hot, strict=True):
                    out.append((k1, k2, a, n, h, s, x))
                    size += len(s) + 60
                if size >= 4 << 20:
                    yield _batch(out, STRING)
                    out, size = [], 0
        if out:
            yield _batch(out, STRING)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for part in slices(b, 5):
                for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if size >= CHUNK_BYTES and row[4] != last:
                        yield _compared(held, spec, compare)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
                    last = row[4]
        if held:
            yield _compared(held, spec, compare)

    picked = keep(rows.select("k1", "k2", "text").mapInArrow(trimmed(chosen), "k1 long, k2 long, first long, n long, anchor long, data binary, hot boolean"), "picked")
    cold = picked.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    parts = [alone, inside, cold.mapInArrow(trimmed(bucket), "k1 long, k2 long, first long, n long")]
    if n_hot:
        stacked = picked.filter("hot")
        buckets = max(1, -(-(stacked.agg(F.sum("n")).first()[0] or 0) // PACK))
        blocks = keep(stacked.select("k1", "k2", "first", "n", "data").mapInArrow(trimmed(_packed_windows(spec, buckets)), "bucket long, block binary"), "blocks")
        known = blocks.filter("bucket < 0").select("block").mapInArrow(_unpacked_bits, BITS)
        met = blocks.filter("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_repeated_windows), BITS)
        bits = known.unionByName(met).groupBy("k1", "k2", "word").agg(F.bit_or("bits").alias("bits"))
        parts.append(bits.select("k1", "k2", "word", "bits").mapInArrow(_ranges_of_bits, "k1 long, k2 long, first long, n long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    out = read_back(out, store(out, "spans"))
    remove(spark, *done)
    return out


#: A window: its digest, where it starts, and whether its task has met it twice.
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("first", "<i8"), ("twice", "<i8")])
#: 64 window starts of a row from 64 * word on, a bit for each that is repeated.
_BITS = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("word", "<i8"), ("bits", "<u8")])
BITS = "k1 long, k2 long, word long, bits long"


def _as_bits(w: np.ndarray) -> np.ndarray:
    """Window starts as words of bits."""
    out = np.zeros(len(w), _BITS)
    out["k1"], out["k2"], out["word"] = w["k1"], w["k2"], w["first"] >> 6
    out["bits"] = np.uint64(1) << (w["first"] & 63).astype(np.uint64)
    if not len(w):
        return out
    out = out[np.lexsort((out["word"], out["k2"], out["k1"]))]
    new = np.concatenate([[True], (out["word"][1:] != out["word"][:-1]) | (out["k2"][1:] != out["k2"][:-1]) | (out["k1"][1:] != out["k1"][:-1])])
    at = np.flatnonzero(new)
    merged = out[at]
    merged["bits"] = np.bitwise_or.reduceat(out["bits"], at)
    return merged


def _by_digest(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by digest, where each digest begins, and whether each entry's digest is repeated."""
    w = w[np.lexsort((w["b"], w["a"]))]
    new = np.concatenate([[True], (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])])[: len(w)]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(w)))
    often = (size > 1) | (np.add.reduceat(w["twice"], at) > 0) if len(at) else np.zeros(0, bool)
    return w, at, np.repeat(often, size)


def _packed_windows(spec: Spec, buckets: int):
    """(k1, k2, first, n, data) to blocks: of windows for each bucket, and of starts known to be repeated for bucket -1."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        w = np.zeros(sum(r[3] for r in rows), _ENTRY)
        digests = b"".join(xxhash.xxh3_128_digest(x) for r in rows for x in spec.windows(r[4], r[3]))
        w["a"], w["b"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        count = np.array([r[3] for r in rows])
        for i, c in enumerate(("k1", "k2", "first")):
            w[c] = np.repeat(np.array([r[i] for r in rows], np.int64), count)
        w["first"] += np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        w, at, often = _by_digest(w)
        w["twice"] = often
        numbers, blocks = [-1], [_as_bits(w[often]).tobytes()]
        w = w[at]  # one of each digest
        bucket = (w["a"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        w, bucket = w[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(w)], strict=True):
            numbers.append(int(bucket[x]))
            blocks.append(w[x:y].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for part in slices(b, 4):
                for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    held.append(row)
                    size += row[3]
                    if size >= PACK:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    return run


def _bits_batch(w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[c]).view(np.int64)) for c in _BITS.names], list(_BITS.names))


def _unpacked_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in b.column(0):
            yield _bits_batch(np.frombuffer(block.as_buffer(), _BITS))


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket to the starts of windows whose digest is met twice in their bucket."""

    def settled(held: list[bytes]) -> pa.RecordBatch:
        w, _, often = _by_digest(np.frombuffer(b"".join(held), _ENTRY))
        return _bits_batch(_as_bits(w[often & (w["twice"] == 0)]))

    held: list[bytes] = []
    last = None
    for b in batches:
        for bucket, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if held and bucket != last:
                yield settled(held)
                held = []
            held.append(block.as_py())
            last = bucket
    if held:
        yield settled(held)


def _ranges_of_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, word, bits) to (k1, k2, first, n): each run of set bits of a word."""
    for b in batches:
        for i in range(0, b.num_rows, 20_000):
            part = b.slice(i, 20_000)
            flags = np.unpackbits(part.column(3).to_numpy().astype("<i8").view(np.uint8), bitorder="little").reshape(-1, 64)
            edges = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
            row, start = np.nonzero(edges == 1)
            end = np.nonzero(edges == -1)[1]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(part.column(2).to_numpy()[row] * 64 + start), pa.array(end - start)], schema=SPAN
            )


_LONG = pa.int64()
RUN = pa.schema([("k1", _LONG), ("k2", _LONG), ("first", _LONG), ("n", _LONG), ("anchor", _LONG), ("digest", pa.binary()), ("more", pa.list_(_LONG))])
STRING = pa.schema([("k1", _LONG), ("k2", _LONG), ("first", _LONG), ("n", _LONG), ("anchor", _LONG), ("data", pa.binary()), ("hot", pa.bool_())])
SPAN = pa.schema([("k1", _LONG), ("k2", _LONG), ("first", _LONG), ("n", _LONG)])


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    a, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])


def _batch(out: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _compared(held: list[tuple], spec: Spec, compare: Compare) -> pa.RecordBatch:
    flags = compare([r[5] for r in held], np.array([r[3] for r in held]), spec.window)
    return _batch([(r[0], r[1], r[2] + a, n) for r, f in zip(held, flags, strict=True) for a, n in ranges(f)], SPAN)


#: What becomes of some rows: (the rows, (first, n) of each one's spans) -> further columns.
Finish = Callable[[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]], list[pa.Array]]
_NO_SPANS = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def finished(docs: DataFrame, spec: Spec, compare: Compare, id_col: str, text_col: str, finish: Finish, added: T.StructType) -> DataFrame:
    """Every row of docs with the added columns, which finish makes from the rows and their spans.

    Rows that have no spans are told apart and finished in their own tasks, so that their texts
    are not shuffled.
    """
    k1, k2, spans_col = "k1", "k2", "spans"
    names, at = docs.columns, docs.columns.index(text_col)
    plain = by_place(docs)
    keyed = plain.select("*", *[k.alias(n) for k, n in zip(row_key(F.col(f"c{names.index(id_col)}"), F.col(f"c{at}")), (k1, k2), strict=True)])
    found = spans(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(f"c{at}").alias("text")), spec, compare)
    have = BitFilter(found, "k2", found.count())
    width = len(names)
    schema = T.StructType([*plain.schema.fields, *[T.StructField(f"d{i}", f.dataType) for i, f in enumerate(added.fields)]])

    def those(b: pa.RecordBatch, passing: bool) -> pa.RecordBatch:
        return b.filter(pa.array(have.passes(b.column(width + 1).to_numpy()) == passing)) if b.num_rows else b

    def made(part: pa.RecordBatch, marks: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns[:width], *finish(part, marks)], schema.names)

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(those(b, False), at):
                yield made(part, [_NO_SPANS] * part.num_rows)

    def have_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield those(b, True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at):
                lists = part.column(width)
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).tolist()
                flat = lists.flatten()
                first, n = (pc.struct_field(flat, i).to_numpy() for i in (0, 1))
                yield made(part, [(first[x:y], n[x:y]) for x, y in zip(ends, ends[1:])])

    found = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans_col))
    rest = keyed.mapInArrow(have_spans, keyed.schema).join(found, [k1, k2], "left").select(*plain.columns, spans_col)
    out = keyed.mapInArrow(trimmed(free), schema).union(rest.mapInArrow(trimmed(cut), schema))
    return out.toDF(*names, *added.names)


def covered(first: np.ndarray, n: np.ndarray, units: int, window: int) -> np.ndarray:
    """Which of some units a window of the spans covers."""
    marks = np.bincount(first, minlength=units + 1)[: units + 1] - np.bincount(first + n + window - 1, minlength=units + 1)[: units + 1]
    return np.cumsum(marks[:-1]) > 0
