"""Comparison of reports, accuracy measures and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kscreen.functions.text import basename, stem


def seconds_between(begin: Column, end: Column) -> Column:
    """Seconds from begin to end, as a double."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / F.lit(1e6)


def parse_time(s: Column) -> Column:
    """Time stamps with or without milliseconds; a trailing offset or Z is dropped. Null where neither fits."""
    bare = F.regexp_replace(s, r"(Z|[+-]\d{2}:?\d{2})$", "")
    formats = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def by_sample(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Reports of two tools joined on the sample's basename; both need their time stamps."""

    def side(reports: DataFrame, name: str) -> DataFrame:
        timed = reports.filter("begin_timestamp is not null and end_timestamp is not null")
        seconds = seconds_between(F.col("begin_timestamp"), F.col("end_timestamp"))
        return timed.select(basename(F.col("sample")).alias("sample"), F.col("contamination_rate").alias(f"rate_{name}"), seconds.alias(f"seconds_{name}"))

    return side(ours, "a").join(side(theirs, "b"), "sample").select("sample", "rate_a", "rate_b", "seconds_a", "seconds_b")


def zipped(ours: DataFrame, theirs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows with the same ordinal whose sample basenames and reference stems agree, where the other
    tool named an organism and both sides have memory figures and times."""

    def side(reports: DataFrame, name: str) -> DataFrame:
        timed = reports.filter("memory is not null and begin_timestamp is not null")
        return timed.select(ordinal, basename(F.col("sample")).alias("sample"), stem(F.col("reference")).alias("reference"), F.col("rate").alias(f"rate_{name}"))

    named = side(theirs.filter("n_organisms > 0"), "b")
    return side(ours, "a").join(named, [ordinal, "sample", "reference"]).select(ordinal, "sample", "reference", "rate_a", "rate_b")


def confusion(rows: DataFrame, called: Column, positive: Column, *by: str) -> DataFrame:
    """Counts and rates of calls against truth, per group. Rates are null where their base is 0."""
    c = rows.groupBy(*by).agg(
        F.count_if(called).alias("called"),
        F.count_if(called & positive).alias("tp"),
        F.count_if(called & ~positive).alias("fp"),
        F.count_if(~called & positive).alias("fn"),
        F.count_if(~called & ~positive).alias("tn"),
    )
    share = lambda a, b: a.cast("double") / F.nullif(b, F.lit(0)).cast("double")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *by, "called", "tp", "fp", "fn", "tn",
        share(tp, tp + fn).alias("tpr"), share(fp, fp + tn).alias("fpr"), share(fp, tp + fp).alias("q_f"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def screen_rate(rows: DataFrame) -> DataFrame:
    """The rate of a screening table: percentages with one and several hits in one library, and one hit in several, over 100."""
    total = F.coalesce(F.sum(F.col("one_hit_one_library") + F.col("multiple_hits_one_library") + F.col("one_hit_multiple_libraries")), F.lit(0.0))
    return rows.groupBy("sample").agg((total / 100).alias("contamination_rate"))


def split_rate(contaminated: Column, clean: Column) -> Column:
    """Contaminated over clean records in whole numbers; 100 without clean records."""
    return F.when(clean == 0, F.lit(100)).otherwise(F.floor(contaminated / F.nullif(clean, F.lit(0))))
