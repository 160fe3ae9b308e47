"""Near-duplicate documents by b-bit MinHash.

Texts with equal shingle sets are one class. A class has K minima; bands of them give candidate
buckets, and the low B bits of all minima, packed, give an estimate of similarity from bit
counts, corrected for chance agreement. Pairs whose estimate is within MARGIN of the threshold
or above are confirmed on the full shingle sets. Not all pairs of a bucket are emitted:

1. each member of a bucket (of a block of it, where it has more than BLOCK members) is paired
   with its likeliest partner; the pairs are confirmed, and the links give components;
2. where a bucket still holds several components, its members come together, two blocks at a
   time, and every remaining pair across components is tried in place, likeliest first, until it
   can join nothing more. The members of the bucket's largest component need not meet each other,
   so only the others are copied to its blocks. Only links leave the task, and a pair is tried
   only in the first band that its two classes share.

Shingle sets never travel: tasks write those that are asked for into files in the shared folder,
rows carry a set's place, and a worker reads the sets of the pairs that it compares, keeping a
bounded number of bytes of them. Links inside a component are not needed for its extent.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kscreen.llm.bitfilter import BitFilter
from kscreen.llm.common import fresh, read_back, remove, row_key, slices, store, taken, trimmed, written
from kscreen.llm.components import components
from kscreen.llm.repeats import mix, word_grams, word_hashes
from kscreen.llm.token_store import filesystem

SHINGLE = 5
#: Shared shingles in a hundred of the union.
PERCENT = 75
K, BANDS, B = 128, 32, 4
#: Five standard deviations of the estimate at the threshold.
MARGIN = 0.2
BLOCK = 512
#: Bytes of shingle sets that a worker keeps.
SET_BYTES = 32 << 20
_ODD = np.random.default_rng(8).integers(0, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_ONES = np.uint64(0x1111111111111111)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; fewer words than SHINGLE make one, no words none."""
    data = (text or "").encode().lower()
    grams = word_grams(data, SHINGLE)
    if not len(grams):
        words = word_hashes(data)
        if not len(words):
            return words
        grams = np.array([len(words)], np.uint64)
        for w in words:
            grams = mix(grams * _ODD[0] + w)
    return np.unique(grams)


def minima(values: np.ndarray) -> np.ndarray:
    """The K minima of a set."""
    out = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 2048):
        np.minimum(out, np.multiply.outer(_ODD, values[i : i + 2048]).min(axis=1), out=out)
    return mix(out)


def packed(mins: np.ndarray) -> np.ndarray:
    """Low B bits of each minimum, 16 to a word."""
    low = (mins & np.uint64(2**B - 1)).reshape(-1, 64 // B)
    return np.bitwise_or.reduce(low << np.arange(0, 64, B, dtype=np.uint64), axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis), corrected for minima that agree by chance."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    share = 1 - np.bitwise_count(x & _ONES).sum(axis=-1, dtype=np.int64) / K
    return (share - 2.0**-B) / (1 - 2.0**-B)


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = mins.reshape(BANDS, -1)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[1]
    for i in range(rows.shape[1]):
        h = mix(h * _ODD[2] + rows[:, i])
    return h


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, 3):
            digest, count, sig, bands = [], [], [], []
            for t in b.column(3).to_pylist():
                s = shingles(t)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                count.append(len(s))
                m = minima(s) if len(s) else None
                sig.append(None if m is None else packed(m).tobytes())
                bands.append(None if m is None else band_keys(m).tobytes())
            made = [pa.array(digest, pa.binary()), pa.array(count, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], ["id", "k1", "k2", "digest", "n_shingles", "sig", "bands"])


def _keys(b: pa.RecordBatch, col: int) -> np.ndarray:
    """The band keys of all rows in a row."""
    return np.frombuffer(b"".join(b.column(col).to_pylist()), np.int64)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_keys(b, 0))], ["key"])


def _by_cell(of_cell: Callable[[list[tuple]], list[tuple[bytes, bytes]]]):
    """Pairs of cells; rows come sorted by cell, the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[tuple] = []
        found: set[tuple[bytes, bytes]] = set()
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                for r in zip(*[c.to_pylist() for c in b.slice(i, 2000).columns], strict=True):
                    if cell and cell[0][0] != r[0]:
                        if len(cell) > 1:
                            found.update((min(p), max(p)) for p in of_cell(cell))
                        cell = []
                    cell.append(r)
            if len(found) > 50_000:
                yield _pair_batch(found)
                found = set()
        if len(cell) > 1:
            found.update((min(p), max(p)) for p in of_cell(cell))
        yield _pair_batch(found)

    return run


class Sets:
    """Shingle sets in files of a shared folder, read by place; keeps the last SET_BYTES of them."""

    def __init__(self, folder: str):
        self.folder = folder
        self.held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self.size = 0
        self.open: OrderedDict[int, pa.NativeFile] = OrderedDict()

    def __call__(self, file: int, at: int, n: int) -> np.ndarray:
        got = self.held.get((file, at))
        if got is None:
            if file not in self.open:
                system, path = filesystem(f"{self.folder}/{file}.sets")
                while len(self.open) >= 32:
                    self.open.popitem(last=False)[1].close()
                self.open[file] = system.open_input_file(path)
            self.open.move_to_end(file)
            got = np.frombuffer(self.open[file].read_at(8 * n, 8 * at), np.uint64)
            self.held[file, at] = got
            self.size += got.nbytes
            while self.size > SET_BYTES and len(self.held) > 2:
                self.size -= self.held.popitem(last=False)[1].nbytes
        else:
            self.held.move_to_end((file, at))
        return got


def _signatures(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)


def _likeliest(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Each row's likeliest partner of another label; rows: (cell, side, digest, sig, label)."""
    sig, out = _signatures(rows), []
    names = {x: i for i, x in enumerate({r[4] for r in rows})}
    label = np.array([names[r[4]] for r in rows])
    for i in range(0, len(rows), 64):
        e = estimate(sig[i : i + 64, None, :], sig[None, :, :])
        e[label[i : i + 64, None] == label[None, :]] = -1
        j = e.argmax(axis=1)
        out += [(rows[i + k][2], rows[j[k]][2]) for k in np.flatnonzero(e[np.arange(len(j)), j] >= PERCENT / 100 - MARGIN)]
    return out


def _remaining(folder: str) -> Callable[[list[tuple]], list[tuple[bytes, bytes]]]:
    sets = Sets(folder)

    def of_cell(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        """Links that join labels; rows: (cell, side, digest, sig, label, band, bands, file, at, n)."""
        left, right = [r for r in rows if r[1] != 1], [r for r in rows if r[1] != 0]
        if not left or not right:
            return []
        sig = [_signatures(side) for side in (left, right)]
        bands = [np.frombuffer(b"".join(r[6] for r in side), np.int64).reshape(len(side), -1) for side in (left, right)]
        names = {x: i for i, x in enumerate({r[4] for r in rows})}
        label = [np.array([names[r[4]] for r in side]) for side in (left, right)]
        root = np.arange(len(names))
        out = []
        for i in range(0, len(left), 64):
            e = estimate(sig[0][i : i + 64, None, :], sig[1][None, :, :])
            e[root[label[0][i : i + 64]][:, None] == root[label[1]][None, :]] = -1
            a, b = np.nonzero(e >= PERCENT / 100 - MARGIN)
            order = np.argsort(-e[a, b], kind="stable")
            a, b = a[order] + i, b[order]
            for j in range(0, len(a), 4096):  # labels join meanwhile
                x, y = a[j : j + 4096], b[j : j + 4096]
                apart = root[label[0][x]] != root[label[1][y]]
                x, y = x[apart], y[apart]
                first = (bands[0][x] == bands[1][y]).argmax(axis=1) == rows[0][5]
                for x, y in zip(x[first].tolist(), y[first].tolist(), strict=True):
                    p, q = root[label[0][x]], root[label[1][y]]
                    if p != q and similar(sets(*left[x][7:10]), sets(*right[y][7:10])):
                        root[root == max(p, q)] = min(p, q)
                        out.append((left[x][2], right[y][2]))
        return out

    return of_cell


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets share enough."""
    if len(s) > len(t):
        s, t = t, s
    if 100 * len(s) < PERCENT * len(t):
        return False
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    common = int((t[at] == s).sum())
    return 100 * common >= PERCENT * (len(s) + len(t) - common)


def _pair_batch(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    pairs = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])


def _confirm(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                places = zip(*[c.to_pylist() for c in part.columns[2:]], strict=True)
                keep = pa.array([similar(sets(*x[:3]), sets(*x[3:])) for x in places], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, n_shingles, label, component_id) of every row of docs; see ``common.row_key`` for k1 and k2.

    Words are runs of bytes other than 0x20 and 0x09-0x0D after A-Z are lower-cased. Null, empty
    and blank texts have no shingles and are components of their own; equal texts, and repeated
    rows, are one component; a component's id is its least id (null if all are null); rows with
    shingles are of one component exactly where label is the same; an empty table gives an empty
    one; other columns are not read, whatever their names. Of a very long text a worker holds the
    text, its set and 16 bytes a word; words are hashed in pieces.
    """
    spark = docs.sparkSession
    done: list[str] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        done.append(store(df, tag))
        return read_back(df, done[-1])

    rows = taken(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    rows = rows.select("id", *row_key(F.col("id"), F.col("text")), "text")
    signed = keep(rows.mapInArrow(trimmed(_sign), "id long, k1 long, k2 long, digest binary, n_shingles long, sig binary, bands binary"), "signed")
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("row"))
    classes = keep(classes, "classes")
    keys = classes.select("bands").mapInArrow(_band_keys, "key long").groupBy("key").count().filter("count > 1").select("key")
    keys = keep(keys, "keys")
    shared = BitFilter(keys, "key", keys.count())
    done.append(shared.path)

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                b = batch.slice(i, 4000)
                key = _keys(b, 2)
                at = np.flatnonzero(shared.passes(key))
                own = pa.array(at // BANDS)
                made = [pa.array(key[at]), pa.array((at % BANDS).astype(np.int32)), b.column(0).take(own), b.column(1).take(own)]
                yield pa.RecordBatch.from_arrays(made, ["key", "band", "digest", "sig"])

    members = keep(classes.select("digest", "sig", "bands").mapInArrow(members_of, "key long, band int, digest binary, sig binary"), "members")
    large = keep(members.groupBy("key").count().filter(F.col("count") > BLOCK), "large")
    own = F.pmod(F.xxhash64("digest", "key"), F.ceil(F.col("count") / BLOCK)).cast("int")
    cell = F.xxhash64("key", F.when(F.col("count").isNull(), -1).otherwise(own)).alias("cell")
    cells = members.join(large, "key", "left").select(cell, F.lit(2).alias("side"), "digest", "sig", F.col("digest").alias("label"))
    pairs = keep(_together(cells).mapInArrow(trimmed(_by_cell(_likeliest)), "a binary, b binary").distinct(), "pairs")
    wanted = keep(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct(), "wanted")
    asked = _asked(wanted)
    folder, sets = _sets(wanted, _only(classes.select("digest", "row"), asked), rows, keep)
    done.extend((folder, asked.path))
    first = pairs.join(sets.toDF("a", "file_a", "at_a", "n_a"), "a").join(sets.toDF("b", "file_b", "at_b", "n_b"), "b")
    first = first.select("a", "b", "file_a", "at_a", "n_a", "file_b", "at_b", "n_b")
    links = keep(first.mapInArrow(trimmed(_confirm(folder)), "a binary, b binary"), "links")
    labels = components(links)
    named = labels.select(F.col("v").alias("digest"), "label")
    # signatures stay behind until it is known which members are needed
    named = members.select("digest", "key", "band").join(named, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    named = keep(named, "named")
    sizes = named.groupBy("key", "label").count()
    split = sizes.groupBy("key").agg(F.max(F.struct("count", "label")).alias("main"), F.sum("count").alias("n"), F.count("*").alias("labels")).filter("labels > 1")
    split = keep(split.select("key", F.col("main.label").alias("main"), F.col("main.count").alias("n_main"), "n"), "split")
    named = keep(named.join(split, "key"), "open")
    wanted = keep(named.select("digest").distinct(), "wanted")
    asked = _asked(wanted)
    folder, sets = _sets(wanted, _only(classes.select("digest", "row"), asked), rows, keep)
    done.extend((folder, asked.path))
    sets = keep(sets.join(_only(classes.select("digest", "sig", "bands"), asked), "digest"), "open-sets")
    open_ = keep(_open_cells(named), "cells").join(sets, "digest")
    open_ = _together(open_.select("cell", "side", "digest", "sig", "label", "band", "bands", "file", "at", "n"))
    more = keep(open_.mapInArrow(trimmed(_by_cell(_remaining(folder))), "a binary, b binary"), "more-links")
    if more.limit(1).count():
        # labels stand for the links that they were made from
        labels = components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = signed.join(labels.select(F.col("v").alias("digest"), "label"), "digest", "left")
    # texts without shingles stand for themselves
    own = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.monotonically_increasing_id().cast("string"))).cast("binary")
    named = named.select("id", "k1", "k2", "n_shingles", F.when(F.col("n_shingles") == 0, own).otherwise(F.coalesce("label", "digest")).alias("label"))
    named = written(named, "near-rows")
    least = written(named.groupBy("label").agg(F.min("id").alias("component_id")), "near-least")
    remove(spark, *done)
    return named.join(least, "label").select("id", "k1", "k2", "n_shingles", "label", "component_id")


def _together(cells: DataFrame) -> DataFrame:
    return cells.repartition("cell").sortWithinPartitions("cell")


def _open_cells(named: DataFrame) -> DataFrame:
    """(cell, side, digest, label, band): members of buckets, n in all, with several labels.

    side: 2 meets all of its cell, 0 and 1 each other. A bucket of at most BLOCK members is one
    cell. In a larger one the n_main members of its largest label, main, are dealt into blocks, the
    others too; every block of main meets every block of others, and every two blocks of others meet.
    """
    is_main, small = F.col("label") == F.col("main"), F.col("n") <= BLOCK
    m, o = (F.greatest(F.ceil(x / BLOCK), F.lit(1)).cast("int") for x in (F.col("n_main"), F.col("n") - F.col("n_main")))
    own = F.pmod(F.xxhash64("digest", "key"), F.when(is_main, m).otherwise(o)).cast("int")

    def cell(kind: int, a: Column, b: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(kind), a, b).alias("cell"), side.cast("int").alias("side"))

    every = lambda count: F.sequence(F.lit(0), count - 1)
    of_main = F.transform(every(o), lambda j: cell(1, F.col("own"), j, F.lit(0)))
    to_main = F.transform(every(m), lambda i: cell(1, i, F.col("own"), F.lit(1)))
    side = lambda j: F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1)
    among = F.transform(every(o), lambda j: cell(2, F.least(F.col("own"), j), F.greatest(F.col("own"), j), side(j)))
    one = F.array(cell(0, F.lit(0), F.lit(0), F.lit(2)))
    cells = F.when(small, one).when(is_main, of_main).otherwise(F.concat(to_main, among))
    rows = named.withColumn("own", own).select("digest", "label", "band", F.explode(cells).alias("c"))
    return rows.select("c.cell", "c.side", "digest", "label", "band")


def _asked(wanted: DataFrame) -> BitFilter:
    """A bit table of some digests."""
    return BitFilter(wanted.select(F.xxhash64("digest").alias("h")).distinct(), "h", wanted.count())


def _only(classes: DataFrame, asked: BitFilter) -> DataFrame:
    """The classes whose digests pass, so that others' columns do not travel to the join that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                last = b.num_columns - 1
                yield pa.RecordBatch.from_arrays(b.columns[:last], b.schema.names[:last]).filter(pa.array(asked.passes(b.column(last).to_numpy())))

    return classes.withColumn("h", F.xxhash64("digest")).mapInArrow(run, classes.schema)


def _sets(wanted: DataFrame, classes: DataFrame, rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[str, DataFrame]:
    """A folder of set files, and (digest, file, at, n) of the wanted classes; no text is shuffled.

    A task writes its sets into a file named after its attempt, so a task that runs again does no harm.
    """
    wanted = keep(classes.join(wanted, "digest").select("digest", "row.k1", "row.k2"), "wanted-rows")
    passing = BitFilter(wanted, "k2", wanted.count())
    folder = fresh(rows.sparkSession, "sets")
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at = TaskContext.get().taskAttemptId(), 0
        system, path = filesystem(f"{folder}/{file}.sets")
        with system.open_output_stream(path) as out:
            for batch in batches:
                if batch.num_rows:
                    batch = batch.filter(pa.array(passing.passes(batch.column(1).to_numpy())))
                for b in slices(batch, 2):
                    places, sizes = [], []
                    for t in b.column(2).to_pylist():
                        s = shingles(t)
                        out.write(s.data)
                        places.append(at)
                        sizes.append(len(s))
                        at += len(s)
                    made = [pa.array([file] * b.num_rows, pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*b.columns[:2], *made], ["k1", "k2", "file", "at", "n"])

    found = keep(rows.select("k1", "k2", "text").mapInArrow(trimmed(sets_of), "k1 long, k2 long, file long, at long, n long"), "set-places")
    found = found.groupBy("k1", "k2").agg(F.min(F.struct("file", "at", "n")).alias("p"))
    remove(rows.sparkSession, passing.path)
    return folder, keep(wanted.join(found, ["k1", "k2"]).select("digest", "p.file", "p.at", "p.n"), "sets")


def brute_force(ids: list[int], texts: list[str | None]) -> dict[int, tuple[int, int, bool]]:
    """id -> (n_shingles, component_id, kept) by all pairs of sets of word tuples; for tests."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set())
    parent = {i: i for i in ids}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            if s and t and 100 * min(len(s), len(t)) >= PERCENT * max(len(s), len(t)):
                common = len(s & t)
                if 100 * common >= PERCENT * (len(s) + len(t) - common):
                    a, b = root(ids[i]), root(ids[j])
                    parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in zip(ids, sets, strict=True)}
