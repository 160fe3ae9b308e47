"""Saved filters and lists of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kscreen.functions.params import Sizing

SUFFIX = ".bloom"


def save(words: DataFrame, k: int, sizing: Sizing, inserts: int, path: str) -> None:
    """Two tables below path: meta (one row) and words."""
    spark = words.sparkSession
    meta = [(k, k * k, sizing.bits, sizing.n_hashes, sizing.capacity, sizing.error_rate, inserts)]
    spark.createDataFrame(meta, "k int, dx int, bits long, n_hashes int, capacity long, error_rate double, inserts long").write.mode("overwrite").parquet(f"{path}/meta")
    words.write.mode("overwrite").parquet(f"{path}/words")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, Sizing, int]:
    """(words, k, sizing, inserts)."""
    m = spark.read.parquet(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/words"), m.k, Sizing(m.bits, m.n_hashes, m.capacity, m.error_rate), m.inserts


def info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/meta").select(F.col("k").alias("word_size"), "bits", F.format_string("%e", "error_rate").alias("error_rate"), "inserts")


def _status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p, fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Filters that path names: itself, the entries of a folder that hold .bloom, or the lines of a text list."""
    fs, p, there = _status(spark, path)
    if not there:
        raise FileNotFoundError(path)
    if SUFFIX in p.getName():
        return [path]
    if fs.getFileStatus(p).isDirectory():
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if SUFFIX in s.getPath().getName())
    return [r[0] for r in spark.read.text(path).filter("trim(value) <> ''").toLocalIterator()]


def total_size(spark: SparkSession, path: str) -> int:
    """Bytes below path, 0 if it is missing."""
    fs, p, there = _status(spark, path)
    return fs.getContentSummary(p).getLength() if there else 0


def filter_path(source: str, target: str | None, target_is_folder: bool) -> str:
    """Where a built filter goes: the target unless it is a folder (or none); then the source's name up to its last dot, with .bloom."""
    if target and not target_is_folder:
        return target
    name = source.rstrip("/").rpartition("/")[2]
    stem = name.rpartition(".")[0] or name
    return (target.rstrip("/") + "/" if target else "") + stem + SUFFIX


def pair_name(query: str, reference: str) -> str:
    """The names of a query and a reference, without folders and last extensions, joined."""
    stem = lambda p: p.rstrip("/").rpartition("/")[2].rpartition(".")[0] or p.rstrip("/").rpartition("/")[2]
    return f"{stem(query)}_{stem(reference)}"


def split_paths(query: str, reference: str, prefix: str, kind: str) -> tuple[str, str]:
    """Names of the contaminated and the clean output; prefix is put in front as it is."""
    base = prefix + pair_name(query, reference)
    return f"{base}_contam.{kind}", f"{base}_clean.{kind}"
