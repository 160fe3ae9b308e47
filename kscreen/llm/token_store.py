"""Token-id files with directly addressable codes.

An id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id, level k the k-th
chunk of the ids that have one; a bitmap per level marks the ids that go on, and a rank
directory holds the number of set bits before every 512-bit block. Token i is read from
``level0[i]``; while its bit is set, i becomes the rank of that bit and the next level follows.
No block is decoded on the way.

File: magic, 8 bytes of header length, JSON header (counts and the place of each section),
sections. Each document ends with the end id. Files are written under names of their own per
task attempt, and only those in the manifest count, so a task that runs again does no harm.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kscreen.llm.common import fresh, slices, taken, trimmed, written
from kscreen.llm.units import UnitCache

MAGIC = b"KSDAC01\n"
BLOCK = 64  # bytes of bitmap for each entry of a rank directory
#: Ids after which a task closes a file and starts another; bounds a worker's memory.
FILE_IDS = 8_000_000
#: Bytes of texts that are encoded at once.
RUN_BYTES = 4 << 20
#: Ids that are read at once (one document at least).
READ_IDS = 500_000


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Levels:
    """The levels of ids that come piece by piece: (chunks, whether each id goes on) of each."""

    def __init__(self):
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def add(self, ids: np.ndarray) -> None:
        rest, level = ids.astype(np.uint32), 0
        while len(rest):
            if level == len(self.parts):
                self.parts.append([])
            more = rest > 0xFF
            self.parts[level].append(((rest & 0xFF).astype(np.uint8), more))
            rest, level = rest[more] >> 8, level + 1

    def packed(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(chunks, bitmap, rank directory) of each level."""
        out = []
        for parts in self.parts or [[]]:
            chunks = np.concatenate([c for c, _ in parts] or [np.zeros(0, np.uint8)])
            bits = np.packbits(np.concatenate([m for _, m in parts] or [np.zeros(0, bool)]), bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), np.arange(0, len(bits), BLOCK)) if len(bits) else np.zeros(0, np.int64)
            out.append((chunks, bits, (np.cumsum(counts) - counts).astype("<u8")))
        return out


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level."""
    levels = Levels()
    levels.add(ids)
    return levels.packed()


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.f = system.open_input_file(path)
        if self.f.read(8) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        size = int.from_bytes(self.f.read(8), "little")
        self.header, self.base = json.loads(self.f.read(size)), 16 + size
        self.n_ids, self.n_docs = self.header["n_ids"], self.header["n_docs"]

    def _part(self, name: str, first: int, count: int) -> bytes:
        self.f.seek(self.base + self.header["sections"][name][0] + first)
        return self.f.read(count)

    def _all(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(self._part(name, 0, self.header["sections"][name][1]), kind)

    def token(self, i: int) -> int:
        """Id i of the file: one chunk, one bit and at most one rank entry and block per level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level in range(self.header["levels"]):
            value |= self._part(f"chunk{level}", i, 1)[0] << 8 * level
            block = i // 8 // BLOCK
            bits = self._part(f"bits{level}", block * BLOCK, i // 8 - block * BLOCK + 1)
            if not bits[-1] >> i % 8 & 1:
                break
            rank = int.from_bytes(self._part(f"rank{level}", 8 * block, 8), "little")
            last = bits[-1] & (1 << i % 8) - 1
            i = rank + int.from_bytes(bits[:-1], "little").bit_count() + last.bit_count()
        return value

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level."""
        block = i // 8 // BLOCK
        if not i or not self.header["sections"][f"rank{level}"][1]:
            return 0
        if 8 * block >= self.header["sections"][f"rank{level}"][1]:
            block -= 1
        bits = self._part(f"bits{level}", block * BLOCK, i // 8 - block * BLOCK + 1)
        inside = int.from_bytes(bits, "little") & (1 << i - block * BLOCK * 8) - 1
        return int.from_bytes(self._part(f"rank{level}", 8 * block, 8), "little") + inside.bit_count()

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b: ids that follow each other have their chunks side by side in every level."""
        out = np.zeros(b - a, "<u4")
        at: np.ndarray | None = None
        for level in range(self.header["levels"]):
            if a == b:
                break
            chunk = np.frombuffer(self._part(f"chunk{level}", a, b - a), "u1").astype("<u4") << np.uint32(8 * level)
            bits = np.frombuffer(self._part(f"bits{level}", a // 8, -(-b // 8) - a // 8), "u1")
            more = np.unpackbits(bits, bitorder="little")[a % 8 : a % 8 + b - a].view(bool)
            if at is None:
                out |= chunk
                at = np.flatnonzero(more)
            else:
                out[at] |= chunk
                at = at[more]
            a = self._rank(level, a)
            b = a + int(more.sum())
        return out

    def ids(self) -> np.ndarray:
        """All ids of the file."""
        return self.slice(0, self.n_ids)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the documents, which of them are null, and the ends of their tokens."""
        return self._all("doc_id", "<i8"), self._all("null", "u1").view(bool), self._all("end", "<i8")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        ends = np.frombuffer(self._part("end", 8 * max(0, k - 1), 16 if k else 8), "<i8")
        return self.slice(int(ends[0]) if k else 0, int(ends[-1]))


def write_file(uri: str, doc_ids: pa.Array, ends: np.ndarray, levels: Levels) -> None:
    parts: dict[str, bytes | np.ndarray] = {
        "doc_id": doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
        "null": doc_ids.is_null().to_numpy(zero_copy_only=False).astype("u1"),
        "end": ends.astype("<i8"),
    }
    packed = levels.packed()
    for k, (chunk, bits, rank) in enumerate(packed):
        parts |= {f"chunk{k}": chunk, f"bits{k}": bits, f"rank{k}": rank}
    at, sections = 0, {}
    for name, data in parts.items():
        sections[name] = (at, data.nbytes)
        at += data.nbytes
    n_ids = int(ends[-1]) if len(ends) else 0
    header = json.dumps({"n_docs": len(doc_ids), "n_ids": n_ids, "levels": len(packed), "sections": sections}).encode()
    system, path = filesystem(uri)
    with system.open_output_stream(path) as f:
        f.write(MAGIC + len(header).to_bytes(8, "little") + header)
        for data in parts.values():
            f.write(np.ascontiguousarray(data).data)


_ENCODERS: dict[str, UnitCache] = {}
#: Units that are encoded as one text.
JOINED = 200


def encoder(tokenizer_path: str) -> UnitCache:
    """One per Python worker and vocabulary; a tokenizer as the library reads it, special tokens included."""
    if tokenizer_path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_path)
        size = np.zeros(t.get_vocab_size(), np.int64)
        for token, i in t.get_vocab().items():
            size[i] = len(token)  # a byte-level token has a character for each byte, an added one is plain ASCII
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        if any(not x.isascii() or x.split() != [x] for x in added):
            raise ValueError("added tokens have to be ASCII without white space")

        def alone(units: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(units, add_special_tokens=False)]

        def joined(units: list[str]) -> list[bytes]:
            """Units that start with one space and end without: joined, they are the matches of one text."""
            ids = np.array(t.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(size[ids])
            wanted = np.cumsum([len(u.encode()) for u in units])
            cut = np.minimum(np.searchsorted(ends, wanted), max(0, len(ends) - 1))
            if not len(ends) or not np.array_equal(ends[cut], wanted):
                return alone(units)
            code, cut = ids.tobytes(), ((cut + 1) * 4).tolist()
            return [code[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

        def encode_new(new: list[bytes]) -> list[bytes]:
            units = [u.decode() for u in new]
            tied = [i for i, u in enumerate(units) if u[:1] == " " and u[1:2] != "" and not u[1].isspace() and not u[-1].isspace()]
            free = sorted(set(range(len(units))).difference(tied))
            out: list[bytes] = [b""] * len(units)
            for i in range(0, len(tied), JOINED):
                part = tied[i : i + JOINED]
                for k, code in zip(part, joined([units[k] for k in part]), strict=True):
                    out[k] = code
            for k, code in zip(free, alone([units[k] for k in free]) if free else [], strict=True):
                out[k] = code
            return out

        # a cut must not fall inside an added token
        _ENCODERS[tokenizer_path] = UnitCache(encode_new, whole="".join(x[1:] for x in added).encode())
    return _ENCODERS[tokenizer_path]


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every whole text as the library does, end it with end_id, write all in ascending id order.

    Null ids come first; a null text counts as empty and gives the end id alone; rows with equal
    ids are ordered by a hash of their texts, and all kept, repeated rows too; an empty table gives
    no file; other columns are not read, whatever their names. A very long text is encoded at once.
    Returns the manifest, one row a file: (part, seq, file, n_docs, n_ids); (part, seq) is the
    order of the files. tokenizer_path: a byte-level BPE with the pattern named in ``units``.
    """
    folder = folder or fresh(docs.sparkSession, "tokens")
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, cache = TaskContext.get(), encoder(tokenizer_path)
        doc_ids: list[pa.Array] = []
        ends: list[np.ndarray] = []
        levels, total, seq = Levels(), 0, 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.ksdac"
            write_file(name, pa.concat_arrays(doc_ids), np.concatenate(ends), levels)
            n_docs = sum(map(len, doc_ids))
            return pa.RecordBatch.from_pydict({"part": [task.partitionId()], "seq": [seq], "file": [name], "n_docs": [n_docs], "n_ids": [total]})

        for batch in batches:
            for piece in slices(batch, 1, RUN_BYTES):
                codes, at = cache.encode(piece.column(1))
                at = at // 4
                levels.add(np.insert(np.frombuffer(codes or b"", "<u4"), at[1:], end_id))
                doc_ids.append(piece.column(0))
                ends.append(total + at[1:] + np.arange(1, len(at)))
                total = int(ends[-1][-1])
                if total >= FILE_IDS:
                    yield close()
                    doc_ids, ends, levels, total, seq = [], [], Levels(), 0, seq + 1
        if doc_ids:
            yield close()

    rows = taken(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # rows of one id, however many, are dealt by text, and equal rows by their places
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "place").select("id", "text")
    return written(rows.mapInArrow(trimmed(run), "part long, seq long, file string, n_docs long, n_ids long"), "manifest")


def _read(manifest: DataFrame, schema: T.StructType, columns: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """One row per document, from the files: id, start, n_tokens, and columns(ids, ends) of some documents at once."""
    whole = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each task that wrote files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    files = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own"))
    files = files.join(bases, "part").select("file", (F.col("base") + F.col("own")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(uri)
                doc_ids, null, ends = f.documents()
                at = np.concatenate([[0], ends])
                i = 0
                while i < len(ends):
                    k = min(len(ends), i + 10_000, max(i + 1, int(np.searchsorted(at, at[i] + READ_IDS, "right")) - 1))
                    own = at[i : k + 1]
                    known = [pa.array(doc_ids[i:k], mask=null[i:k]), pa.array(base + own[:-1]), pa.array(np.diff(own))]
                    yield pa.RecordBatch.from_arrays([*known, *columns(f.slice(int(own[0]), int(own[-1])), own - own[0])], schema.names)
                    i = k

    return files.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def _schema(id_col: str, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])


def read_store(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: (id_col, start, n_tokens, ids).

    start is the number of ids before the document in the whole store. A task reads a file in
    slices of READ_IDS ids.
    """
    make = lambda ids, ends: [pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), pa.array(ids.view("<i4")))]
    return _read(manifest, _schema(id_col, "ids", T.ArrayType(T.IntegerType())), make)


def read_crc(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same with ids_crc32, of all ids as little-endian 32-bit integers, in the place of ids."""
    make = lambda ids, ends: [pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.int64())]
    return _read(manifest, _schema(id_col, "ids_crc32", T.LongType()), make)
