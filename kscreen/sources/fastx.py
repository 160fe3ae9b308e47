"""FASTA and FASTQ. Compressed files are read as they are, but cannot be split.

FASTA is read with '>' as the line separator: a record is its header line and all bytes up to
the next '>', so files split at records. FASTQ is strict: four lines a record; lines are numbered
within their file by a running count over file blocks, never by one global window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kscreen.functions.text import strip_newlines


def format_of(path: str) -> str:
    """By name: .fastq or .fq in it, else FASTA."""
    return "fastq" if ".fastq" in path or ".fq" in path else "fasta"


def marker_format(first: str) -> str:
    """By first character; anything else raises."""
    if first[:1] not in (">", "@"):
        raise ValueError("neither FASTA nor FASTQ: a reference starts with > or @")
    return "fasta" if first[0] == ">" else "fastq"


def read_fasta(spark: SparkSession, paths: str | list[str], reference: bool = False) -> DataFrame:
    """(file, header, seq, raw). Text before a file's first '>' is skipped. Line feeds leave the sequence;
    carriage returns do in a reference only."""
    rows = spark.read.option("lineSep", ">").text(paths).select(F.input_file_name().alias("file"), "value", F.col("_metadata.file_block_start").alias("_at"))
    rows = rows.mapInArrow(_without_heads, rows.schema)
    at = F.instr("value", "\n")
    header = F.when(at > 0, F.substring(F.col("value"), F.lit(1), at - 1)).otherwise(F.col("value"))
    body = F.when(at > 0, F.substring(F.col("value"), at + 1, F.length("value"))).otherwise(F.lit(""))
    rows = rows.filter("value <> ''").select("file", header.alias("header"), strip_newlines(body, reference).alias("seq"), F.concat(F.lit(">"), "value").alias("raw"))
    return rows


def _without_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, value, _at) of a scan without what precedes a file's first marker: the first row of its first block."""
    last: tuple = (None, None)
    for b in batches:
        keep = []
        for now in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            keep.append(now == last or now[1] != 0)
            last = now
        yield b.filter(pa.array(keep, pa.bool_()))


def _numbered(lines: DataFrame) -> DataFrame:
    """lines: (file, value), one partition's lines in file order. Adds line_no from 0 in each file.

    A line's number is its place in its partition plus the lines of the file's earlier partitions;
    one row for each file and partition goes through the only window.
    """
    own = lines.select("file", "value", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    sizes = own.groupBy("file", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = sizes.select("file", "_part", "_first", F.expr("coalesce(sum(_n) over (partition by file order by _part rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    return own.join(before, ["file", "_part"]).select("file", "value", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, read_no, header, seq, plus, qual, raw). Incomplete records at the end and blank lines there are dropped."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.input_file_name().alias("file"), "value")
    rows = _numbered(lines).select("file", F.floor(F.col("line_no") / 4).alias("read_no"), (F.col("line_no") % 4).alias("_k"), "value")
    parts = {"header": 0, "seq": 1, "plus": 2, "qual": 3}
    out = rows.groupBy("file", "read_no").agg(*[F.max(F.when(F.col("_k") == k, F.col("value"))).alias(c) for c, k in parts.items()])
    out = out.filter(F.col("header").startswith("@") & F.col("qual").isNotNull())
    return out.withColumn("raw", F.concat_ws("\n", *parts)).withColumn("raw", F.concat("raw", F.lit("\n")))


def reference_format(spark: SparkSession, path: str) -> str:
    """By the first character of the file's first line that is not empty."""
    first = spark.read.text(path).filter("value <> ''").limit(1).collect()
    return marker_format(first[0][0] if first else "")


def read(spark: SparkSession, path: str, reference: bool = False) -> DataFrame:
    """Reads by name; reference sequences by their first character."""
    kind = reference_format(spark, path) if reference else format_of(path)
    return read_fastq(spark, path) if kind == "fastq" else read_fasta(spark, path, reference)


def fasta_record(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq, F.lit("\n"))


def fastq_record(header: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), header, F.lit("\n"), seq, F.lit("\n+\n"), qual, F.lit("\n"))


def _unended(raw_col: str) -> Column:
    return F.regexp_replace(raw_col, r"\n\z", "").alias("value")


def write_records(records: DataFrame, path: str, raw_col: str = "raw", gzip: bool = False) -> None:
    """Records as they stand, each ended by one line feed; a file a partition."""
    w = records.select(_unended(raw_col)).write.mode("append")
    (w.option("compression", "gzip") if gzip else w).text(path)


def write_split(classified: DataFrame, path: str, raw_col: str = "raw") -> None:
    """One folder of contaminated and one of clean records, from one pass; replaces what is there."""
    rows = classified.select(_unended(raw_col), F.when(F.col("contaminated"), "contam").otherwise("clean").alias("verdict"))
    rows.write.mode("overwrite").partitionBy("verdict").text(path)


def print_split(classified: DataFrame, clean: TextIO, contaminated: TextIO, raw_col: str = "raw") -> None:
    """Clean records to one stream and contaminated ones to the other, a partition at a time, in the reads' order."""
    for r in classified.select(raw_col, "contaminated").toLocalIterator():
        (contaminated if r[1] else clean).write(r[0])


def dummy_fastq(spark: SparkSession, n: int, spike: str, unit: str = "GATTACAT", times: int = 13) -> DataFrame:
    """One spiked read and n repeats of unit: (read_no, header, seq, qual)."""
    seq = F.when(F.col("id") == 0, F.lit(spike)).otherwise(F.lit(unit * times))
    rows = spark.range(n + 1).select(F.col("id").alias("read_no"), F.concat(F.lit("read"), F.col("id").cast("string")).alias("header"), seq.alias("seq"))
    return rows.withColumn("qual", F.expr("repeat('I', length(seq))"))
