"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors x, y with cosine >= c have squared distance <= t = 2 - 2c. After a fixed random
rotation the coordinates are split into BLOCKS blocks; in at least one of them the squared
distance is at most t / BLOCKS. Vectors are dealt into chunks by range: sorted by bins of each
block's first coordinate that are as wide as the block's radius. A chunk knows its range in every
coordinate, and two chunks meet in those blocks alone whose ranges come within the radius. There,
pairs within the block's budget are candidates, and each is verified on the whole vectors in
double precision.

Vectors never travel: the tasks that read them write the chunks to files in the shared folder,
and a tile, that is every chunk of one run against every chunk of another, reads them from there.
Two chunks meet in one tile, so a link is counted once; counts and a spanning forest leave a
tile, not pairs. Working tables are in proportion to the input; the comparisons are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kscreen.llm.common import fresh, read_back, remove, store, taken, trimmed, written
from kscreen.llm.components import components
from kscreen.llm.token_store import filesystem

BLOCKS = 4
#: Vectors of a chunk; fewer where they are so long that a chunk would have more than ROOM numbers.
CHUNK, ROOM = 4096, 4 << 20
#: Bytes of vectors that a task sorts into chunks at once.
SORTED_BYTES = 16 << 20
#: Chunks of a run: a SHARE of all, RUN at most.
SHARE, RUN = 16, 64
#: Room for rounding in the candidate test; the verification decides.
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_slices(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _radius(cosine: float, dim: int) -> float:
    return float(np.sqrt(max(2 - 2 * cosine, 0) / len(block_slices(dim)))) + SLACK


def _budget(cosine: float, dim: int) -> float:
    """Squared distance within a block up to which a pair may be linked, with room for rounding; bins are as wide as its root."""
    return _radius(cosine, dim) ** 2 + SLACK


_ROTATIONS: dict[int, np.ndarray] = {}


def _rotated(unit: np.ndarray) -> np.ndarray:
    dim = unit.shape[-1]
    if dim not in _ROTATIONS:
        _ROTATIONS[dim] = rotation(dim)
    return unit @ _ROTATIONS[dim]


def _usable(col: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) by length: those that may link, negative zeros made positive."""
    offsets = col.offsets.to_numpy()
    there = col.is_valid().to_numpy(zero_copy_only=False)
    whole = col.values.is_valid().to_numpy(zero_copy_only=False) if col.values.null_count else None
    values = col.values.to_numpy(zero_copy_only=False)
    sizes = np.where(there, np.diff(offsets), 0)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        at = offsets[rows][:, None] + np.arange(dim)
        x = values[at] + 0.0
        ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if whole is not None:
            ok &= whole[at].all(axis=1)
        yield rows[ok], x[ok]


class _Chunks:
    """Different vectors that wait to be sorted into chunks of a task's file."""

    def __init__(self, out: pa.NativeFile, file: int, cosine: float, chunk: int):
        self.out, self.file, self.cosine, self.chunk = out, file, cosine, chunk
        self.at = self.entries = self.size = 0
        self.waiting: dict[tuple[int, bool], dict[bytes, list]] = {}

    def add(self, x: np.ndarray) -> list[bytes]:
        """Digests of the rows of x. Single precision is kept where it holds the same numbers."""
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        wide, digests = (short != x).any(axis=1).tolist(), []
        for i, w in enumerate(wide):
            d = xxhash.xxh3_128_digest(x[i].tobytes())
            digests.append(d)
            held = self.waiting.setdefault((x.shape[1], w), {})
            if d in held:
                held[d][1] += 1
            else:
                held[d] = [(x if w else short)[i].tobytes(), 1]
                self.size += len(held[d][0])
        return digests

    def written(self) -> list[tuple]:
        """(file, at, n, dim, wide, entry, low, high) of the chunks that the waiting vectors make."""
        made = []
        for (dim, wide), held in self.waiting.items():
            digests, raw = list(held), [r for r, _ in held.values()]
            weight = np.array([w for _, w in held.values()], np.int64)
            y = _rotated(_unit(np.frombuffer(b"".join(raw), np.float64 if wide else np.float32).astype(np.float64).reshape(-1, dim)))
            bins = np.floor(y[:, [s.start for s in block_slices(dim)]] / np.sqrt(_budget(self.cosine, dim)))
            order = np.lexsort(bins.T[::-1])
            most = _most(dim, self.chunk)
            for i in range(0, len(order), most):
                part = order[i : i + most]
                data = b"".join([*(digests[k] for k in part), weight[part].tobytes(), *(raw[k] for k in part)])
                self.out.write(data)
                made.append((self.file, self.at, len(part), dim, wide, (self.file << 32) + self.entries, y[part].min(axis=0).tobytes(), y[part].max(axis=0).tobytes()))
                self.at += len(data)
                self.entries += len(part)
        self.waiting, self.size = {}, 0
        return made


def _most(dim: int, chunk: int) -> int:
    return max(1, min(chunk, ROOM // dim))


_STORED = "id long, digest binary, file long, at long, n long, dim int, wide boolean, entry long, low binary, high binary"
_PLACE = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]


def _stored(folder: str, cosine: float, chunk: int):
    """(id, vector) to rows with id and digest, null where the vector links with nothing, and rows with a chunk's place.

    A task writes its chunks into a file named after its attempt, so a task that runs again does no harm.
    """

    def batch(ids: pa.Array, digests: list[bytes | None], places: list[tuple]) -> pa.RecordBatch:
        n, m = len(ids), len(places)
        first = [pa.concat_arrays([ids, pa.nulls(m, ids.type)]), pa.array(digests + [None] * m, pa.binary())]
        rest = [pa.array([None] * n + [p[i] for p in places], t) for i, t in enumerate(_PLACE)]
        return pa.RecordBatch.from_arrays(first + rest, [c.split()[0] for c in _STORED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().taskAttemptId()
        system, path = filesystem(f"{folder}/{file}.vectors")
        with system.open_output_stream(path) as out:
            chunks = _Chunks(out, file, cosine, chunk)
            for b in batches:
                digests: list[bytes | None] = [None] * b.num_rows
                places = []
                for rows, x in _usable(b.column(1)):
                    for row, d in zip(rows.tolist(), chunks.add(x), strict=True):
                        digests[row] = d
                if chunks.size > SORTED_BYTES:
                    places = chunks.written()
                yield batch(b.column(0), digests, places)
            last = chunks.written()
        yield batch(pa.nulls(0, pa.int64()), [], last)

    return run


class _Side:
    """The vectors of a group of chunks, ready to be compared."""

    def __init__(self, folder: str, chunks: list[dict], cosine: float):
        digests, weight, x, entry = [], [], [], []
        for c in chunks:
            system, path = filesystem(f"{folder}/{c['file']}.vectors")
            n, real = c["n"], np.float64 if c["wide"] else np.float32
            with system.open_input_file(path) as f:
                data = f.read_at(24 * n + n * c["dim"] * np.dtype(real).itemsize, c["at"])
            digests.append(np.frombuffer(data, np.uint64, 2 * n).reshape(n, 2))
            weight.append(np.frombuffer(data, np.int64, n, 16 * n))
            x.append(np.frombuffer(data, real, n * c["dim"], 24 * n).reshape(n, -1).astype(np.float64))
            entry.append(c["entry"] + np.arange(n))
        self.digests, self.weight, self.entry = np.concatenate(digests), np.concatenate(weight), np.concatenate(entry)
        self.unit = _unit(np.concatenate(x))
        y, dim = _rotated(self.unit), self.unit.shape[1]
        self.left, self.right = [], []
        for s in block_slices(dim):
            own = y[:, s]
            norm, one = (own * own).sum(axis=1, keepdims=True), np.ones((len(own), 1))
            room = _budget(cosine, dim) + (own.shape[1] + 2) * 2.0**-20  # more than single precision rounds off
            self.left.append(np.hstack([2 * own, room - norm, one]).astype(np.float32))
            self.right.append(np.hstack([own, one, -norm]).astype(np.float32).T)


def _near_blocks(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cosine: float) -> list[int]:
    """Blocks in which two boxes (low, high) come within the budget."""
    gap = np.maximum(np.maximum(b[0] - a[1], a[0] - b[1]), 0)
    dim = len(gap)
    return [i for i, s in enumerate(block_slices(dim)) if (gap[s] ** 2).sum() <= _budget(cosine, dim)]


def _pairs(a: _Side, b: _Side, same: bool, blocks: list[int], cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of verified links."""
    width = len(b.weight)
    for i in range(0, len(a.weight), 512):
        near = np.zeros((min(512, len(a.weight) - i), -(-width // 8) * 8), bool)
        for k in blocks:
            near[:, :width] |= a.left[k][i : i + 512] @ b.right[k] >= 0
        words = np.flatnonzero(near.reshape(-1, 8).view(np.uint64).ravel())  # few have any
        if not len(words):
            continue
        w, at = np.nonzero(near.reshape(-1, 8)[words])
        p, q = np.divmod(words[w] * 8 + at, near.shape[1])
        p += i
        if same:
            p, q = p[p < q], q[p < q]
        for j in range(0, len(p), 16_384):
            x, y = p[j : j + 16_384], q[j : j + 16_384]
            linked = ((a.unit[x] * b.unit[y]).sum(axis=1) >= cosine) | (a.digests[x] == b.digests[y]).all(axis=1)
            yield x[linked], y[linked]


def _hook(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the trees of each pair: larger roots to smaller ones until the ends of every pair agree."""
    while len(p):
        np.minimum.at(root, root[p], root[q])
        np.minimum.at(root, root[q], root[p])
        while (root != (up := root[root])).any():
            root[:] = up
        open_ = root[p] != root[q]
        p, q = p[open_], q[open_]


_FOUND = "v binary, entry long, weight long, links long, root binary"


def _joined(folder: str, plan: str, cosine: float):
    """Tiles (dim, a, b, run): all of the run of groups from a against all of the run from b. Emits a row for every vector with a link there."""

    def groups() -> dict[tuple[int, int], list[dict]]:
        system, path = filesystem(plan)
        out: dict[tuple[int, int], list[dict]] = {}
        for c in pq.read_table(path, filesystem=system).to_pylist():
            out.setdefault((c["dim"], c["g"]), []).append(c)
        return out

    def of_tile(known: dict, dim: int, first: int, second: int, run: int) -> pa.RecordBatch:
        members = sorted({g for start in (first, second) for g in range(start, start + run) if (dim, g) in known})
        boxes = {g: tuple(pick([np.frombuffer(c[k]) for c in known[dim, g]], axis=0) for k, pick in (("low", np.min), ("high", np.max))) for g in members}
        base = dict(zip(members, np.cumsum([0, *(sum(c["n"] for c in known[dim, g]) for g in members)]).tolist()))
        n = sum(c["n"] for g in members for c in known[dim, g])
        links, root = np.zeros(n, np.int64), np.arange(n)
        digests, weight, entry = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        open_: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for g in [g for g in members if g < first + run]:
            a = None
            for h in [h for h in members if h >= max(g, second)]:
                if not (blocks := _near_blocks(boxes[g], boxes[h], cosine)):
                    continue
                a = a or _Side(folder, known[dim, g], cosine)
                b = a if g == h else _Side(folder, known[dim, h], cosine)
                for side, start in ((a, base[g]), (b, base[h])):
                    at = slice(start, start + len(side.weight))
                    digests[at], weight[at], entry[at] = side.digests, side.weight, side.entry
                for p, q in _pairs(a, b, g == h, blocks, cosine):
                    links[base[g] : base[g] + len(a.weight)] += np.bincount(p, b.weight[q], len(a.weight)).astype(np.int64)
                    links[base[h] : base[h] + len(b.weight)] += np.bincount(q, a.weight[p], len(b.weight)).astype(np.int64)
                    open_.append((p + base[g], q + base[h]))
                    waiting += len(p)
                    if waiting > 200_000:
                        _hook(root, *map(np.concatenate, zip(*open_, strict=True)))
                        open_, waiting = [], 0
        if open_:
            _hook(root, *map(np.concatenate, zip(*open_, strict=True)))
        at = np.flatnonzero(links)
        names = [pa.array([d.tobytes() for d in digests[i]], pa.binary()) for i in (at, root[at])]
        return pa.RecordBatch.from_arrays([names[0], *[pa.array(x[at]) for x in (entry, weight, links)], names[1]], [c.split()[0] for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            for tile in zip(*[c.to_pylist() for c in b.columns], strict=True):
                known = known or groups()
                yield of_tile(known, *tile)

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing
    and are components of their own, as are vectors whose length no other has. Equal vectors link
    (repeated rows with them). A component's id is the least id in it, null if all are null; an empty
    table gives an empty one; other columns are not read, whatever their names. Of very long vectors
    a chunk has fewer, one at least.
    """
    spark = df.sparkSession
    done: list[str] = []

    def keep(x: DataFrame, tag: str) -> DataFrame:
        done.append(store(x, tag))
        return read_back(x, done[-1])

    rows = taken(df, id=id_col, v=vector_col).select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    folder = fresh(spark, "vector-chunks")
    done.append(folder)
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    stored = keep(rows.mapInArrow(trimmed(_stored(folder, cosine, CHUNK)), _STORED), "vectors")
    rows, chunks = stored.filter("n is null").select("id", "digest"), stored.filter("n is not null").drop("id", "digest")
    # chunks that are not full share a group
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("file", "at")) - F.col("n")
    most = F.greatest(F.lit(1), F.least(F.lit(CHUNK), F.floor(F.lit(ROOM) / F.col("dim"))))
    chunks = keep(chunks.withColumn("g", F.floor(before / most).cast("int")), "vector-groups")
    plan = done[-1]
    runs = chunks.groupBy("dim").agg((F.max("g") + 1).alias("count"))
    runs = runs.withColumn("run", F.greatest(F.lit(1), F.least(F.lit(RUN), F.floor(F.col("count") / SHARE))).cast("int"))
    tiles = runs.select("dim", "run", "count", F.explode(F.expr("sequence(0, count - 1, run)")).alias("a"))
    tiles = keep(tiles.select("dim", "a", F.explode(F.expr("sequence(a, count - 1, run)")).alias("b"), "run"), "vector-tiles")
    count = tiles.count()
    tasks = max(1, min(count, max(4 * spark.sparkContext.defaultParallelism, count // 4)))
    found = keep(tiles.repartition(tasks).mapInArrow(trimmed(_joined(folder, plan, cosine)), _FOUND), "vector-links")
    labels = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    # tasks that read equal vectors each stored one: every such entry has met all the others
    counts = found.groupBy("v", "entry").agg((F.sum("links") + F.first("weight") - 1).alias("links")).groupBy("v").agg(F.max("links").alias("links"))
    known = rows.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("weight"))
    known = known.join(counts.withColumnRenamed("v", "digest"), "digest", "left").join(labels.withColumnRenamed("v", "digest"), "digest", "left")
    known = keep(known.select("digest", F.coalesce("links", F.col("weight") - 1).alias("n_links"), F.coalesce("label", "digest").alias("label")), "vector-known")
    single = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.monotonically_increasing_id().cast("string"))).cast("binary")
    named = rows.join(known, "digest", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", single).alias("label"))
    named = written(named, "vector-rows")
    least = written(named.groupBy("label").agg(F.min("id").alias("component_id")), "vector-least")
    remove(spark, *done)
    return named.join(least, "label").select("id", "n_links", "component_id")


def brute_force(ids: list[int], vectors: list[list[float] | None], cosine: float = 0.9) -> dict[int, tuple[int, int, bool]]:
    """id -> (n_links, component_id, kept) by all pairs; for tests."""
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [_unit(np.asarray(v, float)) if u else None for v, u in zip(vectors, usable, strict=True)]
    links, near = dict.fromkeys(ids, 0), dict(zip(ids, ids, strict=True))
    pairs = []
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and float((a * b).sum()) >= cosine:
                pairs.append((ids[i], ids[j]))
                links[ids[i]] += 1
                links[ids[j]] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(near[a], near[b])
            if near[a] != low or near[b] != low:
                near[a] = near[b] = low
                changed = True
    return {i: (links[i], near[i], near[i] == i) for i in ids}
