"""Bloom filters as tables: one row of meta data and one row for each word of 64 bits.

Two hash families: md5 (built in, the same in any engine) and the Jenkins hash (``jenkins``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kscreen.functions.jenkins import SEEDS, hash36
from kscreen.functions.params import Sizing

#: Bits of a filter that is sent to the executors whole at most (32 MB).
SHIP_BITS = 1 << 28


def md5_place(kmer: Column, i: int, bits: int) -> Column:
    """Hash number i of a k-mer: 36 bits of an md5, modulo the number of bits."""
    return F.conv(F.substring(F.md5(F.concat(kmer, F.lit(f":{i}")).cast("binary")), 1, 9), 16, 10).cast("long") % bits


def md5_places(kmer: Column, n_hashes: int, bits: int) -> Column:
    return F.array(*[md5_place(kmer, i, bits) for i in range(n_hashes)])


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def words(places: DataFrame) -> DataFrame:
    """places: a column place, one row for each set bit (repeats allowed). (word_idx, word), partial and final OR."""
    return places.groupBy(F.shiftright("place", 6).alias("word_idx")).agg(F.bit_or(bit(F.col("place"))).alias("word"))


def build(kmers: DataFrame, sizing: Sizing) -> DataFrame:
    """The filter's words from distinct k-mers, by md5."""
    return words(kmers.select(F.explode(md5_places(F.col("kmer"), sizing.n_hashes, sizing.bits)).alias("place")))


def contains(queries: DataFrame, filter_words: DataFrame, sizing: Sizing) -> DataFrame:
    """queries (distinct k-mers in kmer; other columns are kept) with in_filter: all bits set. No false negatives.

    A filter of at most ``SHIP_BITS`` goes to every task as one row, and a k-mer's hashes are taken
    only until a bit is missing; nothing is shuffled. Beyond that, the words are joined by key.
    """
    if sizing.bits <= SHIP_BITS:
        every = queries.sparkSession.range(-(-sizing.bits // 64)).withColumnRenamed("id", "word_idx").join(filter_words, "word_idx", "left")
        held = every.agg(F.sort_array(F.collect_list(F.struct("word_idx", F.coalesce("word", F.lit(0)).alias("word"))))["word"].alias("_words"))
        places = [md5_place(F.col("kmer"), i, sizing.bits) for i in range(sizing.n_hashes)]
        hits = [F.get("_words", F.shiftright(p, 6).cast("int")).bitwiseAND(bit(p)) != 0 for p in places]
        return queries.crossJoin(F.broadcast(held)).select(*queries.columns, reduce(Column.__and__, hits).alias("in_filter"))
    probes = queries.select("*", F.explode(F.array_distinct(md5_places(F.col("kmer"), sizing.n_hashes, sizing.bits))).alias("place"))
    probes = probes.withColumn("word_idx", F.shiftright("place", 6))
    found = probes.join(filter_words, "word_idx", "left")
    hit = F.coalesce(F.col("word").bitwiseAND(bit(F.col("place"))) != 0, F.lit(False))
    return found.groupBy(*queries.columns).agg(F.bool_and(hit).alias("in_filter"))


def jenkins_places(kmers: DataFrame, sizing: Sizing) -> DataFrame:
    """(kmer, place): the places of k-mers of equal UTF-8 length per call, by the Jenkins hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [(x or "") for x in b.column(0).to_pylist()]
            data = [x.encode() for x in keys]
            by: dict[int, list[int]] = {}
            for i, d in enumerate(data):
                by.setdefault(len(d), []).append(i)
            for size, at in by.items():
                matrix = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), size)
                for seed in SEEDS[: sizing.n_hashes]:
                    place = (hash36(matrix, seed) % np.uint64(sizing.bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at]), pa.array(place)], ["kmer", "place"])

    return kmers.select("kmer").mapInArrow(run, "kmer string, place long")


def build_jenkins(kmers: DataFrame, sizing: Sizing) -> DataFrame:
    return words(jenkins_places(kmers, sizing))


def contains_jenkins(queries: DataFrame, filter_words: DataFrame, sizing: Sizing) -> DataFrame:
    probes = jenkins_places(queries, sizing).distinct().withColumn("word_idx", F.shiftright("place", 6))
    hit = F.coalesce(F.col("word").bitwiseAND(bit(F.col("place"))) != 0, F.lit(False))
    return probes.join(filter_words, "word_idx", "left").groupBy("kmer").agg(F.bool_and(hit).alias("in_filter"))


def info(kmers: DataFrame, k: int, sizing: Sizing) -> DataFrame:
    """The printed facts of a filter: word size, bits, hashes, error rate and distinct k-mers."""
    return kmers.agg(F.count("*").alias("inserts")).select(
        F.lit(k).alias("word_size"),
        F.lit(sizing.bits).cast("long").alias("bits"),
        F.lit(sizing.n_hashes).alias("n_hashes"),
        F.lit(sizing.capacity).cast("long").alias("capacity"),
        F.format_string("%e", F.lit(sizing.error_rate)).alias("error_rate"),
        "inserts",
    )
