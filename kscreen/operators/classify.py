"""Scoring and classification of reads against a k-mer set.

A window of a read matches when its k-mer is in the set. With m matching windows in r maximal
runs, a read of length L scores (m k + m + (k - 1) r) / (k L + L - k k), as a 32-bit float; it
is contaminated when the score reaches the threshold, m is not 0 and k is not 1. The full check
of a strand happens only if one of its anchor windows matches, and the reverse complement is
looked at only when the forward strand does not pass.

Two ways, same rows. Where the set is small enough to ship (``SHIP_KMERS``, counted before any
k-mer goes to the driver; filters of ``bloom.SHIP_BITS``), a vectorised kernel classifies in
place without any shuffle; it is built once per Python worker. Beyond that, windows are joined to
the set by key and folded back by read. Where only verdicts are asked for, the kernel looks at
anchors first, at all windows of reads with a matching anchor, and at the reverse complement of
reads that do not pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kscreen.functions.jenkins import SEEDS, hash36
from kscreen.functions.params import Sizing
from kscreen.functions.text import BASES, COMPLEMENTS, revcomp
from kscreen.operators.kmers import windows

#: Distinct k-mers of all filters together that are sent to the executors at most.
SHIP_KMERS = 1_000_000

STRAND = ("m", "runs", "blocks", "gate", "anchor_hits")
_SWAP = str.maketrans(BASES, COMPLEMENTS)
_R = np.uint64(0x9E3779B97F4A7C15)


def denominator(length: Column, k: int) -> Column:
    return F.lit(k + 1) * length - F.lit(k * k)


def score(m: Column, runs: Column, length: Column, k: int) -> Column:
    """Null for reads below k."""
    top = F.lit(k + 1) * m + F.lit(k - 1) * runs
    return F.when(length >= k, (top.cast("double") / denominator(length, k).cast("double")).cast("float"))


def passes(m: Column, score_: Column, k: int, threshold: float) -> Column:
    if k < 2:
        return F.lit(False)
    return F.coalesce((m > 0) & (score_ >= F.lit(threshold).cast("float")), F.lit(False))


def _codes(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all reads, one code point each, and the reads' lengths."""
    length = np.fromiter(map(len, seqs), np.int64, len(seqs))
    return np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), "<u4"), length


def _window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(codes) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= _R
        h += codes[j : j + n]
    h ^= h >> np.uint64(29)
    return h


class Kernel:
    """Classifies reads against one set of k-mers; subclasses tell which windows are in it."""

    def __init__(self, k: int):
        self.k = k

    def known(self, codes: np.ndarray, at: np.ndarray, seqs: list[str], read: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which windows are in the set. at: where they start in codes, in order; read, pos: the same within seqs."""
        raise NotImplementedError

    def _windows(self, start: np.ndarray, length: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(read, position) of every step-th window; for a step above 1 of a read's last window too."""
        last = length - self.k
        count = np.where(last >= 0, last // step + 1 + ((last % step > 0) if step > 1 else 0), 0)
        read = np.repeat(np.arange(len(length)), count)
        place = np.arange(len(read)) - np.repeat(np.cumsum(count) - count, count)
        return read, np.minimum(place * step, last[read])

    def matches(self, seqs: list[str], gated: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(read, window start) of every match in order, and the reads' lengths.

        gated: only of reads with a matching anchor.
        """
        codes, length = _codes(seqs)
        start = np.cumsum(length) - length
        chosen = np.arange(len(seqs))
        if gated:
            read, pos = self._windows(start, length, self.k)
            chosen = np.unique(read[self.known(codes, start[read] + pos, seqs, read, pos)])
        read, pos = self._windows(start[chosen], length[chosen], 1)
        read = chosen[read]
        hit = self.known(codes, start[read] + pos, seqs, read, pos)
        return read[hit], pos[hit], length

    def strand(self, seqs: list[str], gated: bool = False) -> dict[str, np.ndarray]:
        """The columns of STRAND for each read. gated: reads without a matching anchor count no match."""
        n, k = len(seqs), self.k
        read, pos, length = self.matches(seqs, gated)
        opens = np.ones(len(read), bool)
        opens[1:] = (read[1:] != read[:-1]) | (pos[1:] != pos[:-1] + 1)
        block = np.ones(len(read), bool)
        block[1:] = (read[1:] != read[:-1]) | (pos[1:] // k != pos[:-1] // k)
        anchor = (pos % k == 0) | (pos == length[read] - k)
        count = lambda flags: np.bincount(read[flags], minlength=n) if flags is not None else np.bincount(read, minlength=n)
        hits = count(anchor)
        return {"m": count(None), "runs": count(opens), "blocks": count(block), "gate": hits > 0, "anchor_hits": hits}

    def strands(self, seqs: list[str], both: bool, threshold: float | None) -> dict[str, np.ndarray]:
        """fwd_ and (both) rev_ columns. With a threshold, only what the verdict at it depends on."""
        fwd = self.strand(seqs, threshold is not None)
        out = {f"fwd_{c}": v for c, v in fwd.items()}
        if not both:
            return out
        todo = np.arange(len(seqs))
        if threshold is not None:
            length = np.fromiter(map(len, seqs), np.int64, len(seqs))
            todo = np.flatnonzero(~self.passing(fwd, length, threshold))
        rev = self.strand([reverse_complement(seqs[i]) for i in todo.tolist()], threshold is not None)
        for c, v in rev.items():
            out[f"rev_{c}"] = np.zeros(len(seqs), v.dtype)
            out[f"rev_{c}"][todo] = v
        return out

    def passing(self, counts: dict[str, np.ndarray], length: np.ndarray, threshold: float) -> np.ndarray:
        """Reads whose gate is open and whose score reaches the threshold; as ``score`` and ``passes``."""
        k, m = self.k, counts["m"]
        if k < 2:
            return np.zeros(len(m), bool)
        top, base = (k + 1) * m + (k - 1) * counts["runs"], (k + 1) * length - k * k
        reached = (top.astype(np.float64) / np.where(length >= k, base, 1)).astype(np.float32) >= np.float32(threshold)
        return counts["gate"] & (m > 0) & (length >= k) & reached


class SetKernel(Kernel):
    """An exact set. Hash hits are checked by text."""

    def __init__(self, kmers: list[str], k: int):
        super().__init__(k)
        self.members = set(kmers)
        self.sorted = np.unique(_window_hashes(_codes(kmers)[0], k)[::k]) if kmers else np.zeros(0, np.uint64)
        # a bit for each low part of a known hash turns most windows away before the search
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.sorted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def known(self, codes: np.ndarray, at: np.ndarray, seqs: list[str], read: np.ndarray, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), bool)
        if not len(self.sorted) or not len(at):
            return out
        if 3 * len(at) > len(codes):  # most windows: by shifting all codes; else each on its own
            h = _window_hashes(codes, self.k)[at]
        else:
            h = np.zeros(len(at), np.uint64)
            for j in range(self.k):
                h *= _R
                h += codes[at + j]
            h ^= h >> np.uint64(29)
        near = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.sorted, h[near]), len(self.sorted) - 1)
        near = near[self.sorted[place] == h[near]]
        k = self.k
        out[near] = np.fromiter((seqs[r][p : p + k] in self.members for r, p in zip(read[near].tolist(), pos[near].tolist(), strict=True)), bool, len(near))
        return out


class BloomKernel(Kernel):
    """A Bloom filter of Jenkins hashes, as its words."""

    def __init__(self, words: np.ndarray, k: int, sizing: Sizing):
        super().__init__(k)
        self.words, self.sizing = words, sizing

    def _holds(self, matrix: np.ndarray) -> np.ndarray:
        """matrix: keys of one length, a row each. A key's further hashes are taken only while its bits are set."""
        left = np.arange(len(matrix))
        for seed in SEEDS[: self.sizing.n_hashes]:
            place = hash36(matrix[left], seed) % np.uint64(self.sizing.bits)
            left = left[(self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
        out = np.zeros(len(matrix), bool)
        out[left] = True
        return out

    def known(self, codes: np.ndarray, at: np.ndarray, seqs: list[str], read: np.ndarray, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), bool)
        wide = np.concatenate([[0], np.cumsum(codes > 127)])
        plain = np.flatnonzero(wide[np.minimum(at + self.k, len(codes))] == wide[at])
        small = codes.astype(np.uint8)
        for i in range(0, len(plain), 200_000):
            part = plain[i : i + 200_000]
            out[part] = self._holds(small[at[part, None] + np.arange(self.k)])
        by: dict[int, list[tuple[int, bytes]]] = {}
        for i in np.setdiff1d(np.arange(len(at)), plain).tolist():
            key = seqs[read[i]][pos[i] : pos[i] + self.k].encode("utf-8", "surrogatepass")
            by.setdefault(len(key), []).append((i, key))
        for size, keys in by.items():
            out[[i for i, _ in keys]] = self._holds(np.frombuffer(b"".join(x for _, x in keys), np.uint8).reshape(-1, size))
        return out


_KERNELS: dict[str, Any] = {}


@dataclass
class Shipped:
    """A kernel's data, sent to each executor once; a worker builds the kernel once and keeps the last few."""

    data: Any  # a broadcast variable
    make: Callable[[Any], Any]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def get(self) -> Any:
        if self.name not in _KERNELS:
            while len(_KERNELS) >= 4:
                _KERNELS.pop(next(iter(_KERNELS)))
            _KERNELS[self.name] = self.make(self.data.value)
        return _KERNELS[self.name]


def shipped(spark: SparkSession, data: Any, make: Callable[[Any], Any]) -> Shipped:
    """data: of a size that the caller has checked."""
    return Shipped(spark.sparkContext.broadcast(data), make)


def reverse_complement(s: str) -> str:
    return s[::-1].translate(_SWAP)


def _fields(prefix: str) -> list[T.StructField]:
    return [T.StructField(f"{prefix}_{c}", T.BooleanType() if c == "gate" else T.LongType()) for c in STRAND]


def kernel_counts(reads: DataFrame, kernel: Shipped, seq_col: str = "seq", both: bool = True, threshold: float | None = None) -> DataFrame:
    """reads with fwd_ and (both) rev_ columns of STRAND, by a shipped kernel."""
    at = reads.columns.index(seq_col)
    prefixes = ("fwd", "rev") if both else ("fwd",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kernel.get()
        for batch in batches:
            for b in _slices(batch, at):
                got = own.strands([s or "" for s in b.column(at).to_pylist()], both, threshold)
                names = [f"{p}_{c}" for p in prefixes for c in STRAND]
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(got[n]) for n in names]], [*b.schema.names, *names])

    return reads.mapInArrow(run, T.StructType([*reads.schema.fields, *[f for p in prefixes for f in _fields(p)]]))


def verdicts_of_many(reads: DataFrame, kernels: dict[str, tuple[Shipped, int, float]], sample_col: str, seq_col: str = "seq") -> DataFrame:
    """(sample_col, filter, contaminated, hits, read_len) of every read and filter; kernels: name -> (kernel, k, threshold)."""
    names = [sample_col, "filter", "contaminated", "hits", "read_len"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, 1):
                seqs = [s or "" for s in b.column(1).to_pylist()]
                length = np.fromiter(map(len, seqs), np.int64, len(seqs))
                for name, (kernel, _, threshold) in kernels.items():
                    own = kernel.get()
                    got = own.strands(seqs, True, threshold)
                    fwd, rev = ({c: got[f"{p}_{c}"] for c in STRAND} for p in ("fwd", "rev"))
                    a, b_ = own.passing(fwd, length, threshold), own.passing(rev, length, threshold)
                    times = np.where(a, 0, np.where(b_, 1, rev["anchor_hits"]))
                    hits = np.where(fwd["gate"], fwd["m"], 0) + times * rev["m"]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(seqs)), pa.array(a | b_), pa.array(hits), pa.array(length)], names)

    return reads.select(sample_col, seq_col).mapInArrow(run, f"`{sample_col}` string, filter string, contaminated boolean, hits long, read_len long")


def _slices(batch: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most some bytes of sequences, or one row."""
    if not batch.num_rows:
        return
    column = batch.column(at)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _joined(reads: DataFrame, reference: DataFrame, k: int, seq: Column, prefix: str, key: list[str], *by: str) -> DataFrame:
    """(key, by, STRAND columns with the prefix) of reads that have a match, by an equi-join of windows with the set.

    by: columns of reference that split the set into filters.
    """
    rows = windows(reads.select(*key, F.length(seq).alias("_n"), seq.alias("_seq")), F.col("_seq"), k, *key, "_n").withColumnRenamed("pos", "_pos")
    hits = rows.join(reference, "kmer").groupBy(*key, *by).agg(F.array_sort(F.collect_set("_pos")).alias("_p"), F.first("_n").alias("_n"))
    p, n = F.col("_p"), F.col("_n")
    before = F.transform("_p", lambda x, i: F.when(i > 0, F.get("_p", i - 1)))
    anchor = F.size(F.filter(p, lambda x: (x % k == 0) | (x == n - k))).cast("long")
    values = {
        "m": F.size(p).cast("long"),
        "runs": F.size(F.filter(F.arrays_zip(p.alias("x"), before.alias("y")), lambda z: z["y"].isNull() | (z["x"] != z["y"] + 1))).cast("long"),
        "blocks": F.size(F.array_distinct(F.transform(p, lambda x: F.floor(x / k)))).cast("long"),
        "gate": anchor > 0,
        "anchor_hits": anchor,
    }
    return hits.select(*key, *by, *[v.alias(f"{prefix}_{c}") for c, v in values.items()])


def _sides(seq_col: str, both: bool) -> list[tuple[str, Column]]:
    return [("fwd", F.col(seq_col)), ("rev", revcomp(F.col(seq_col)))][: 2 if both else 1]


def _none(prefix: str) -> dict[str, int | bool]:
    return {f"{prefix}_{c}": False if c == "gate" else 0 for c in STRAND}


def window_counts(
    reads: DataFrame, reference: DataFrame, k: int, key: list[str], seq_col: str = "seq", both: bool = True, threshold: float | None = None, ship: int | None = None
) -> DataFrame:
    """reads with fwd_ and (both) rev_ columns of STRAND.

    reference: distinct k-mers in a column kmer. key names a read; it is needed beyond ``ship`` k-mers
    only. With a threshold, counts that no verdict at it depends on may be left at 0.
    """
    limit = SHIP_KMERS if ship is None else ship
    if reference.count() <= limit:
        known = reference.select("kmer").toArrow().column(0).to_pylist()
        return kernel_counts(reads, shipped(reads.sparkSession, known, lambda x: SetKernel(x, k)), seq_col, both, threshold)
    out = reads
    for prefix, seq in _sides(seq_col, both):
        out = out.join(_joined(reads, reference, k, seq, prefix, key), key, "left").na.fill(_none(prefix))
    return out


def filter_counts(
    reads: DataFrame, reference: DataFrame, filter_col: str, k: int, seq_col: str = "seq", both: bool = True, key: list[str] | None = None, ship: int | None = None
) -> DataFrame:
    """The same for the pairs of a read and a filter of reference (filter_col long, kmer) that have a match.

    All filters are looked up at once, so a read's windows are hashed once however many filters
    there are, and pairs without a match make no row. Beyond ``ship`` k-mers of all filters
    together, windows are joined to the filters' k-mers; key names a read and is needed then.
    """
    limit = SHIP_KMERS if ship is None else ship
    if reference.count() > limit:
        if not key:
            raise ValueError(f"more than {limit} k-mers: key has to name a read")
        pairs = None
        for prefix, seq in _sides(seq_col, both):
            side = _joined(reads, reference.select(filter_col, "kmer"), k, seq, prefix, key, filter_col)
            pairs = side if pairs is None else pairs.join(side, [*key, filter_col], "full")
        out = reads.join(pairs.na.fill({n: v for prefix, _ in _sides(seq_col, both) for n, v in _none(prefix).items()}), key)
        return out.select(*reads.columns, *[c for c in pairs.columns if c not in key])
    rows = reference.select(F.col(filter_col).cast("long"), "kmer").toArrow()
    kernel = shipped(reads.sparkSession, (rows.column(0).to_pylist(), rows.column(1).to_pylist()), lambda x: _FilterKernel(*x, k))
    at = reads.columns.index(seq_col)
    prefixes = ("fwd", "rev") if both else ("fwd",)
    names = [*reads.columns, filter_col, *[f"{p}_{c}" for p in prefixes for c in STRAND]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kernel.get()
        for batch in batches:
            for b in _slices(batch, at):
                seqs = [s or "" for s in b.column(at).to_pylist()]
                counts = [own.by_filter(x) for x in ([seqs, [reverse_complement(s) for s in seqs]] if both else [seqs])]
                pairs = sorted(set().union(*counts))
                none = dict.fromkeys(STRAND, 0) | {"gate": False}
                cols = [c.take(pa.array([read for _, read in pairs], pa.int64())) for c in b.columns]
                cols.append(pa.array([f for f, _ in pairs], pa.int64()))
                cols += [pa.array([c.get(x, none)[name] for x in pairs], pa.bool_() if name == "gate" else pa.int64()) for c in counts for name in STRAND]
                yield pa.RecordBatch.from_arrays(cols, names)

    return reads.mapInArrow(run, T.StructType([*reads.schema.fields, T.StructField(filter_col, T.LongType()), *[f for p in prefixes for f in _fields(p)]]))


class _FilterKernel(SetKernel):
    """The k-mers of several filters at once."""

    def __init__(self, filters: list[int], kmers: list[str], k: int):
        self.filters: dict[str, list[int]] = {}
        for f, x in zip(filters, kmers, strict=True):
            self.filters.setdefault(x, []).append(f)
        super().__init__(list(self.filters), k)

    def by_filter(self, seqs: list[str]) -> dict[tuple[int, int], dict]:
        """(filter, read) -> the columns of STRAND."""
        k = self.k
        read, pos, length = self.matches(seqs)
        places: dict[tuple[int, int], list[int]] = {}
        for r, p in zip(read.tolist(), pos.tolist(), strict=True):
            for f in self.filters[seqs[r][p : p + k]]:
                places.setdefault((f, r), []).append(p)
        out = {}
        for (f, r), ps in places.items():
            n = int(length[r])
            anchors = sum(p % k == 0 or p == n - k for p in ps)
            out[f, r] = {"m": len(ps), "runs": 1 + sum(b != a + 1 for a, b in zip(ps, ps[1:])), "blocks": len({p // k for p in ps}), "gate": anchors > 0, "anchor_hits": anchors}
        return out


def verdicts(counted: DataFrame, k: int, threshold: float, seq_col: str = "seq", both: bool = True) -> DataFrame:
    """counted with read_len, scores, contaminated and hits.

    hits: m of the forward strand if it was checked; if it did not pass, m of the reverse strand
    once if that passes, else once for every matching anchor of the reverse strand.
    """
    n = F.length(seq_col)
    out = counted.withColumn("read_len", n.cast("long")).withColumn("fwd_score", score(F.col("fwd_m"), F.col("fwd_runs"), n, k))
    fwd = F.col("fwd_gate") & passes(F.col("fwd_m"), F.col("fwd_score"), k, threshold)
    hits = F.when(F.col("fwd_gate"), F.col("fwd_m")).otherwise(F.lit(0))
    if not both:
        return out.withColumn("contaminated", fwd).withColumn("hits", hits)
    out = out.withColumn("rev_score", score(F.col("rev_m"), F.col("rev_runs"), n, k))
    rev = F.col("rev_gate") & passes(F.col("rev_m"), F.col("rev_score"), k, threshold)
    times = F.when(fwd, F.lit(0)).when(rev, F.lit(1)).otherwise(F.col("rev_anchor_hits"))
    return out.withColumn("fwd_pass", fwd).withColumn("rev_pass", ~fwd & rev).withColumn("contaminated", fwd | rev).withColumn("hits", hits + times * F.col("rev_m"))
