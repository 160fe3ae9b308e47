"""Build, query, remove and info, as functions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kscreen.functions import params
from kscreen.functions.text import ascii_lower
from kscreen.operators import bloom, classify, kmers, report, sampling
from kscreen.sources import fastx, filters

READ = ["file", "read_no"]


def _sequences(spark: SparkSession, path: str) -> DataFrame:
    """Reads with a number that is unique in the table, lower-cased for matching; raw keeps its case."""
    rows = fastx.read(spark, path)
    if "read_no" not in rows.columns:
        rows = rows.withColumn("read_no", F.monotonically_increasing_id())
    return rows.select("file", "read_no", ascii_lower(F.col("seq")).alias("seq"), "raw")


def reference_kmers(spark: SparkSession, source: str, k: int) -> DataFrame:
    return kmers.kmer_set(fastx.read(spark, source, reference=True), "seq", k)


def build(spark: SparkSession, source: str, target: str | None = None, k: int = 0, error_rate: float = params.API_ERROR_RATE) -> str:
    """Build a filter from a FASTA or FASTQ reference and return its path.

    k = 0 chooses k by the source's size; the capacity is the source's size in bytes. target: the
    filter's path, or a folder, with a slash at its end.
    """
    size = filters.total_size(spark, source)
    if not size:
        raise ValueError(f"{source} is empty or missing")
    return _build(spark, source, target, k or params.default_k(size), params.sizing(size, error_rate))


def build_list(spark: SparkSession, sources: list[str], folder: str | None = None, k: int = 0, error_rate: float = params.API_ERROR_RATE) -> list[str]:
    """A filter for each reference, in folder or where the command runs, named after its reference.

    The capacity of a FASTQ reference is half its size, as half its lines are no sequence.
    """
    paths = [filters.filter_path(s, folder, True) for s in sources]
    if len(set(paths)) < len(paths):
        raise ValueError("references of the same name would overwrite each other's filters")
    for source, path in zip(sources, paths, strict=True):
        size = filters.total_size(spark, source)
        if not size:
            raise ValueError(f"{source} is empty or missing")
        capacity = size // 2 if fastx.reference_format(spark, source) == "fastq" else size
        _build(spark, source, path, k or params.default_k(size), params.sizing(max(1, capacity), error_rate))
    return paths


def _build(spark: SparkSession, source: str, target: str | None, k: int, sizing: params.Sizing) -> str:
    known = reference_kmers(spark, source, k)
    path = filters.filter_path(source, target, bool(target) and target.endswith("/"))
    filters.save(bloom.build_jenkins(known, sizing), k, sizing, known.count(), path)
    known.write.mode("overwrite").parquet(f"{path}/kmers")
    return path


def classified(spark: SparkSession, query: str, filter_path: str, threshold: float = 0.0, rate: float = 1.0, exact: bool = False) -> DataFrame:
    """The query's reads with their verdicts. threshold 0 is the default of the filter's k.

    exact screens against the filter's k-mers themselves; otherwise a k-mer counts when the filter holds it.
    """
    words, k, sizing, _ = filters.load(spark, filter_path)
    threshold = threshold or params.default_threshold(k)
    reads = _sequences(spark, query)
    reads = sampling.sample(reads, rate, F.concat_ws(":", *READ))
    if exact:
        counted = classify.window_counts(reads, spark.read.parquet(f"{filter_path}/kmers"), k, READ, threshold=threshold)
    elif sizing.bits <= bloom.SHIP_BITS:
        counted = classify.kernel_counts(reads, _shipped(words, k, sizing), threshold=threshold)
    else:
        both = reads.select("seq").union(reads.select(F.reverse(F.translate("seq", "acgt", "tgca"))))
        asked = kmers.windows(both, F.col("seq"), k).select("kmer").distinct()
        known = bloom.contains_jenkins(asked, words, sizing).filter("in_filter").select("kmer")
        counted = classify.window_counts(reads, known, k, READ, threshold=threshold)
    return classify.verdicts(counted, k, threshold)


def _shipped(words: DataFrame, k: int, sizing: params.Sizing) -> classify.Shipped:
    """A filter of at most SHIP_BITS, sent to the executors."""
    rows = words.select("word_idx", "word").toArrow()
    array = np.zeros(-(-sizing.bits // 64), np.int64)
    array[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return classify.shipped(words.sparkSession, array.tobytes(), lambda x: classify.BloomKernel(np.frombuffer(x, np.uint64), k, sizing))


def query(spark: SparkSession, query_path: str, filter_path: str, threshold: float = 0.0, rate: float = 1.0, exact: bool = False) -> DataFrame:
    """The report document of one sample against one filter."""
    begin = spark.sql("select current_timestamp() t").first()[0]
    k = filters.load(spark, filter_path)[1]
    rows = classified(spark, query_path, filter_path, threshold, rate, exact)
    return report.document(report.report(rows, k), query_path, filter_path, F.lit(begin), spark.sparkContext.defaultParallelism)


def query_many(spark: SparkSession, samples: list[str], filter_paths: list[str], threshold: float = 0.0) -> DataFrame:
    """Every sample against every filter: one pass over all samples for the filters that can be shipped.

    A task looks a batch of reads up in one filter after the other; a read makes one narrow row for
    each filter, which is summed in the task. Larger filters are queried one by one.
    """
    if not samples or not filter_paths:
        raise ValueError("no samples or no filters")
    begin = spark.sql("select current_timestamp() t").first()[0]
    loaded = {f: filters.load(spark, f) for f in filter_paths}
    small = {f: x for f, x in loaded.items() if x[2].bits <= bloom.SHIP_BITS}
    out = [query(spark, s, f, threshold) for f in filter_paths if f not in small for s in samples]
    if small:
        kernels = {f: (_shipped(words, k, sizing), k, threshold or params.default_threshold(k)) for f, (words, k, sizing, _) in small.items()}
        reads = reduce(DataFrame.unionByName, [_sequences(spark, s).select(F.lit(s).alias("sample"), "seq") for s in samples])
        sums = classify.verdicts_of_many(reads, kernels, "sample").groupBy("sample", "filter").agg(*report.totals())
        every = spark.createDataFrame([(s, f, small[f][1]) for s in samples for f in small], "sample string, filter string, k int")
        sums = every.join(sums, ["sample", "filter"], "left").na.fill(0)
        for k in sorted({x[1] for x in small.values()}):
            rows = report.with_rates(sums.filter(F.col("k") == k), k)
            out.append(report.document(rows, F.col("sample"), F.col("filter"), F.lit(begin), spark.sparkContext.defaultParallelism))
    return reduce(DataFrame.unionByName, out)


def remove(spark: SparkSession, query_path: str, filter_path: str, target: str, threshold: float = 0.0, exact: bool = False) -> None:
    """Split the reads into contaminated and clean ones below target, from one pass."""
    fastx.write_split(classified(spark, query_path, filter_path, threshold, exact=exact), target)


def remove_many(spark: SparkSession, query_path: str, filter_paths: list[str], folder: str, threshold: float = 0.0, exact: bool = False) -> list[str]:
    """A split for each filter, in a folder of its own below folder, named after the query and the filter."""
    targets = [f"{folder.rstrip('/')}/{filters.pair_name(query_path, f)}" for f in filter_paths]
    if len(set(targets)) < len(targets):
        raise ValueError("filters of the same name would overwrite each other's splits")
    for f, target in zip(filter_paths, targets, strict=True):
        remove(spark, query_path, f, target, threshold, exact)
    return targets


def info(spark: SparkSession, filter_path: str) -> DataFrame:
    return filters.info(spark, filter_path)
