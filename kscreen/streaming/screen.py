"""Screening of streams of documents: stateless classification, running sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kscreen.operators import classify, kmers, report
from kscreen.plans.folders import scratch


def classified_stream(docs: DataFrame, reference: DataFrame, k: int, threshold: float, tile: int) -> DataFrame:
    """Documents as classified tiles. A stream itself needs a reference small enough to ship; a batch of one does not."""
    tiles = kmers.tiles(docs, "text", tile, "doc_id")
    return classify.verdicts(classify.window_counts(tiles, reference, k, ["doc_id", "tile_no"]), k, threshold)


def running_totals(stream: DataFrame, *by: str) -> DataFrame:
    """Sums so far, for the complete or update output mode."""
    return stream.groupBy(*(by or [F.lit(0).alias("all")])).agg(*report.totals())


def split_batches(path: str):
    """For foreachBatch: one classification pass, two folders, each batch replaced if it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("doc_id", "tile_no", "seq", F.when(F.col("contaminated"), "contam").otherwise("clean").alias("verdict"))
        rows.write.mode("overwrite").partitionBy("verdict").parquet(f"{path}/batch={number}")

    return write


def streamed_report(spark: SparkSession, sf_dir: str, reference: DataFrame, k: int, threshold: float, tile: int) -> DataFrame:
    """The report of documents read as a file stream, to its end; per-batch sums are written and added up.

    Each batch is classified as a table of its own, so that the reference may be of any size.
    """
    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).schema
    out = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"

    def add(batch: DataFrame, number: int) -> None:
        classified_stream(batch, reference, k, threshold, tile).agg(*report.totals()).write.mode("overwrite").parquet(f"{out}/sums/batch={number}")

    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(source)
    query = docs.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    names = ("total_read_count", "contaminated_reads", "total_hits", "all_k")
    sums = spark.read.parquet(f"{out}/sums").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return report.with_rates(sums, k)
