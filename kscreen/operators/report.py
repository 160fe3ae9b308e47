"""Reports over classified reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kscreen.functions.params import default_hit_probability
from kscreen.functions.significance import p_value


def ratio(a: Column, b: Column) -> Column:
    """a / b as a 32-bit float, not a number where b is 0."""
    share = (a.cast("double") / F.nullif(b, F.lit(0)).cast("double")).cast("float")
    return F.when(b == 0, F.lit(float("nan")).cast("float")).otherwise(share)


def totals() -> list[Column]:
    """Partial and final sums in the engine: counts of reads, contaminated reads, hits and bases."""
    return [
        F.count("*").alias("total_read_count"),
        F.count_if("contaminated").alias("contaminated_reads"),
        F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("total_hits"),
        F.coalesce(F.sum("read_len"), F.lit(0)).cast("long").alias("all_k"),
    ]


def report(classified: DataFrame, k: int, *by: str | Column) -> DataFrame:
    """One row per group: totals, contamination_rate and p_value."""
    sums = classified.groupBy(*by).agg(*totals()) if by else classified.agg(*totals())
    return with_rates(sums, k)


def filter_report(matched: DataFrame, reads: DataFrame, filters: DataFrame, filter_col: str, k: int, seq_col: str = "seq") -> DataFrame:
    """One row per filter, from the pairs that have a match: every filter has seen all reads."""
    sums = matched.groupBy(filter_col).agg(F.count_if("contaminated").alias("c"), F.sum("hits").alias("h"))
    seen = reads.agg(F.count("*").alias("total_read_count"), F.coalesce(F.sum(F.length(seq_col)), F.lit(0)).cast("long").alias("all_k"))
    rows = filters.select(filter_col).distinct().join(sums, filter_col, "left").crossJoin(F.broadcast(seen))  # seen is one row
    rows = rows.select(filter_col, "total_read_count", F.coalesce("c", F.lit(0)).alias("contaminated_reads"), F.coalesce("h", F.lit(0)).cast("long").alias("total_hits"), "all_k")
    return with_rates(rows, k)


def with_rates(sums: DataFrame, k: int) -> DataFrame:
    return sums.withColumn("contamination_rate", ratio(F.col("contaminated_reads"), F.col("total_read_count"))).withColumn(
        "p_value", p_value(F.col("total_hits"), F.col("all_k"), F.lit(default_hit_probability(k)))
    )


def document(row: DataFrame, sample: str | Column, reference: str | Column, begin: Column, threads: int) -> DataFrame:
    """The flat report documents of samples and filters, named by a text or in a column."""
    from kscreen.functions.text import iso_timestamp

    return row.select(
        iso_timestamp(begin).alias("begin_timestamp"),
        iso_timestamp(F.current_timestamp()).alias("end_timestamp"),
        F.lit(sample).alias("sample"),  # a column stays as it is
        F.lit(reference).alias("bloom_filter"),
        "total_read_count",
        "contaminated_reads",
        "total_hits",
        "contamination_rate",
        "p_value",
        F.lit(threads).alias("threads"),
    )


TSV_COLUMNS = ("sample", "bloom_filter", "total_read_count", "contaminated_reads", "contamination_rate", "p_value")


def tsv(doc: DataFrame) -> DataFrame:
    """Six columns with six names, rates as %f and the p-value as %e."""
    shown = [F.format_string("%f", "contamination_rate").alias("contamination_rate"), F.format_string("%e", "p_value").alias("p_value")]
    return doc.select(*TSV_COLUMNS[:4], *shown)
