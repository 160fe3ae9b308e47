"""Toxicity by compression distance.

Separate zstandard dictionaries are trained on toxic and on ordinary text. The trainer gets runs
of SAMPLE_WORDS words of whole texts, none chosen or left out, and keeps what recurs in them. All
dictionaries share one that is trained on all ordinary text, its entropy tables included; to that
a toxic one adds what was trained on a third of the toxic texts, and its ordinary counterpart
what was trained on as many ordinary texts. There are PAIRS such pairs, so what a dictionary holds
by chance of its few texts is not in the others.

A window is a word with its spaces and a fixed tail that all dictionaries hold, so that only the
word's own cost differs. Its distance in a pair is the number of bytes that the toxic dictionary
saves over the ordinary one; what counts are the least and the middle distance of the pairs. A
text's score comes from how many of its windows pass each threshold (LEAST, MIDDLE); the
thresholds' weights are calibrated on folds that the dictionaries had not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kscreen.llm.common import by_place, slices, taken, trimmed, unused

#: Labelled rows of each class, in the order of a hash, that the model is fitted on at most.
SAMPLE_ROWS = 1500
PAIRS, SAMPLE_WORDS = 3, 12
#: Bytes of the shared dictionary and of what each class adds to it.
SHARED_BYTES, OWN_BYTES = 110_000, 60_000
#: Bytes saved from which a window counts, in every pair and in most pairs.
LEAST, MIDDLE = (1, 2, 3), (2, 3, 4)
#: Words from which a text's length counts against chance passes.
LONG = 100
#: Words in the younger half of a worker's memory; when it is full it becomes the older half, from which
#: words that are met again come back.
CACHE_LIMIT = 120_000
TAIL_BYTES = 48
#: Bytes of texts whose distinct words are looked up at once.
RUN_BYTES = 4 << 20
_EDGE = ".,;:!?\"'()[]{}<>*#$%&/\\|=+-_~`^@…«»„“”‘’¡¿"
#: Repeat offsets that end the tables of a trained dictionary, as its format lays down.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def plain(word: str) -> str:
    """A window's word: lower case, without punctuation at its ends unless nothing else is left."""
    return word.lower().strip(_EDGE) or word.lower()


def windows(text: str | None) -> list[str]:
    """The words of a text's windows."""
    return [plain(w) for w in (text or "").split()]


def _distinct(docs: list[list[str]]) -> list[list[str]]:
    """Documents without those that share their two longest words with an earlier one."""
    seen, out = set(), []
    for ws in docs:
        key = tuple(sorted(set(ws), key=lambda w: (-len(w), w))[:2])
        if key not in seen:
            seen.add(key)
            out.append(ws)
    return out


def _samples(docs: list[list[str]]) -> list[bytes]:
    return [f" {' '.join(ws[i : i + SAMPLE_WORDS])} ".encode("utf-8", "replace") for ws in docs for i in range(0, len(ws), SAMPLE_WORDS)]


def _train(docs: list[list[str]], size: int) -> tuple[bytes, bytes]:
    """(tables, content) of a dictionary trained on whole texts; too little text is content as it is, without tables."""
    samples = _samples(docs)
    try:
        made = zstandard.train_dictionary(size, samples, k=48, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"", b"".join(samples)[-size:]
    cut = made.index(_OFFSETS) + len(_OFFSETS)
    return made[:cut], made[cut:].lstrip(b"\0")


@dataclass
class Dictionaries:
    """pairs: (what a toxic dictionary adds to the shared one, what its ordinary counterpart adds)."""

    tables: bytes
    shared: bytes
    pairs: list[tuple[bytes, bytes]]
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    older: dict[str, int] = field(default_factory=dict, repr=False)
    ready: list | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"tables": self.tables, "shared": self.shared, "pairs": self.pairs, "cache": {}, "older": {}, "ready": None}

    def _open(self) -> list[tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]]:
        p = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=18, hash_log=17, search_log=5, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        kind = zstandard.DICT_TYPE_FULLDICT if self.tables else zstandard.DICT_TYPE_RAWCONTENT

        def opened(own: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(self.tables + self.shared + own, dict_type=kind)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

        return [(opened(a), opened(b)) for a, b in self.pairs]

    def level(self, word: str) -> int:
        """The least and the middle distance of the word's window, each below LEVELS: least * LEVELS + middle."""
        got = self.cache.get(word)
        if got is not None:
            return got
        got = self.older.get(word)
        if got is None:
            if self.ready is None:
                self.ready = self._open()
            window = f" {word} ".encode("utf-8", "replace") + self.shared[-TAIL_BYTES:]
            saved: list[int] = []
            for toxic, ordinary in self.ready:
                saved.append(len(ordinary.compress(window)) - len(toxic.compress(window)))
                if len(saved) > len(self.ready) // 2 and max(saved) <= 0:
                    break  # neither the least nor the middle can pass a threshold any more
            saved.sort()
            least, middle = (saved[0], saved[len(saved) // 2]) if saved else (0, 0)
            got = min(max(least, 0), LEVELS - 1) * LEVELS + min(max(middle, 0), LEVELS - 1)
        if len(self.cache) >= CACHE_LIMIT:
            self.cache, self.older = {}, self.cache
        self.cache[word] = got
        return got

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: windows that pass each threshold and windows in all, logarithmic, as
        chance passes grow with a text's length."""
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        there = pc.not_equal(flat, "")  # white space at an end splits off an empty one
        words = flat.filter(there).dictionary_encode()
        level = np.array([self.level(plain(w)) for w in words.dictionary.to_pylist()], np.int64)
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[there.to_numpy(zero_copy_only=False)]
        sizes = np.bincount(owner, minlength=len(texts))
        counts = np.bincount(owner * LEVELS**2 + level[words.indices.to_numpy()], minlength=len(texts) * LEVELS**2) if len(owner) else np.zeros(len(texts) * LEVELS**2)
        counts = counts.reshape(len(texts), LEVELS, LEVELS)
        passed = [counts[:, t:, :].sum(axis=(1, 2)) for t in LEAST] + [counts[:, :, t:].sum(axis=(1, 2)) for t in MIDDLE]
        return np.column_stack([*[np.log1p(x) for x in passed], np.maximum(0, np.log(np.maximum(1, sizes) / LONG))])


LEVELS = max(LEAST + MIDDLE) + 1


def fit_dictionaries(toxic: list[list[str]], ordinary: list[list[str]]) -> Dictionaries:
    """toxic, ordinary: the words of texts. Near copies count once. Without texts of both classes there are no pairs."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    tables, shared = _train(ordinary, SHARED_BYTES)
    if not toxic or not ordinary:
        return Dictionaries(tables, shared, [])
    step = max(1, len(ordinary) * PAIRS // len(toxic))  # as many ordinary texts as toxic ones
    groups = [(toxic[g::PAIRS] or toxic, ordinary[g::step] or ordinary) for g in range(PAIRS)]
    return Dictionaries(tables, shared, [(_train(a, OWN_BYTES)[1], _train(b, OWN_BYTES)[1]) for a, b in groups])


@dataclass
class Model:
    dictionaries: Dictionaries
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = self.dictionaries.features(texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def fit(rows: list[tuple], folds: int = 3) -> Model:
    """rows: texts, labels (1 toxic) and, where classes were sampled unevenly, how many labelled rows
    each stands for. The thresholds' weights come from folds left out in turn."""
    data = [(windows(r[0]), r[1]) for r in rows]
    share = np.array([r[2] if len(r) > 2 else 1.0 for r in rows])
    at = np.concatenate([np.arange(k, len(rows), folds) for k in range(folds)])
    xs = []
    for k in range(folds):
        rest = [d for i, d in enumerate(data) if i % folds != k]
        own = fit_dictionaries([w for w, y in rest if y], [w for w, y in rest if not y])
        xs.append(own.features(pa.array([r[0] for r in rows[k::folds]], pa.string())))
    y = np.array([r[1] for r in rows], float)[at]
    return Model(fit_dictionaries([w for w, y in data if y], [w for w, y in data if not y]), _logistic(np.concatenate(xs), y, share[at] if len(share) else share))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; a text without marked windows keeps the class share seen among such texts."""
    if not len(y):
        return np.array([-5.0] + [0.0] * x.shape[1])
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-4
    share = share * len(share) / share.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (share * (y - p)) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> list[tuple[str | None, int, float]]:
    """At most rows labelled texts of each class, whole, in the order of a hash of their ids: (text, label, labelled ids it stands for).

    Ids whose crc32 as text mod 4 is 2 are held out; rows with a null id or label are skipped. An id
    with several labels has the greatest, one with several texts the least text; ids without a row
    in docs give none.
    """
    lab = taken(labels, _id=id_col, _y=label_col).filter("_id is not null and _y is not null and crc32(cast(_id as string)) % 4 != 2")
    lab = lab.groupBy("_id").agg(F.max(F.col("_y").cast("int")).alias("_y"))
    labelled = [0, 0]
    for r in lab.groupBy((F.col("_y") == 1).alias("toxic")).count().collect():
        labelled[int(r[0])] = r[1]
    parts = [lab.filter((F.col("_y") == 1) == bool(y)).orderBy(F.xxhash64("_id"), "_id").limit(rows) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = taken(docs, _id=id_col, _text=text_col).join(F.broadcast(chosen), "_id")  # at most 2 x rows
    texts = texts.groupBy("_id", "_y").agg(F.min("_text").alias("_text"), F.xxhash64("_id").alias("_at"))
    out = [(r._text, int(r._y == 1)) for r in sorted(texts.collect(), key=lambda r: (r._at, str(r._id)))]
    used = [sum(y == c for _, y in out) for c in (0, 1)]
    return [(t, y, labelled[y] / used[y]) for t, y in out]


def _scored(model: Model, text_at: int, names: list[str], keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_at, RUN_BYTES):
                yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(model.scores(b.column(text_at)))], names)

    return trimmed(run)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row; cases as in ``with_score``."""
    rows = taken(docs, id=id_col, text=text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select("id", text.alias("text")).mapInArrow(_scored(model, 1, schema.names, 1), schema)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "_score") -> DataFrame:
    """docs with one more column, out_col: 0 to 1, higher where label 1 is likelier.

    Null and empty texts get the score of a text without marked windows; rows are scored one by one,
    so equal texts, in repeated rows too, have equal scores; an empty table gives an empty one; of
    a very long text a worker holds its distinct words. docs may have any other columns; one of
    out_col's name, in any case, raises.
    """
    if unused(docs, out_col) != [out_col]:
        raise ValueError(f"docs has a column {out_col} already")
    at, plain = docs.columns.index(text_col), by_place(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(_scored(model, at, schema.names, len(docs.columns)), schema).toDF(*docs.columns, out_col)
