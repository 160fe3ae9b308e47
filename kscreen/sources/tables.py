"""Report stores and tables of other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kscreen.functions.text import stem
from kscreen.operators.report import tsv

REPORT = """begin_timestamp string, end_timestamp string, sample string, bloom_filter string, total_read_count long,
    contaminated_reads long, total_hits long, contamination_rate float, p_value double, threads int"""


def write_json(doc: DataFrame, path: str) -> None:
    """Appends a report document to a store of JSON files."""
    doc.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def write_tsv(doc: DataFrame, path: str) -> None:
    tsv(doc).write.mode("append").option("sep", "\t").option("header", True).csv(path)


#: Columns of a screening tool's table: the library, then a count and a percentage of each kind.
SCREEN_COLUMNS = (
    "Library", "#Reads_processed", "#Unmapped", "%Unmapped", "#One_hit_one_library", "%One_hit_one_library", "#Multiple_hits_one_library", "%Multiple_hits_one_library",
    "#One_hit_multiple_libraries", "%One_hit_multiple_libraries", "Multiple_hits_multiple_libraries", "%Multiple_hits_multiple_libraries",
)


def read_screen_reports(spark: SparkSession, path: str, sample: Column | None = None) -> DataFrame:
    """The tables below path as reports: one row per sample, with its libraries and the percentages that a rate is made of.

    sample: from the column file; by default the file's name without its extension. The rate
    follows the first library, as in the reports it is compared with (``compare.screen_rate``).
    """
    names = [
        "library", "processed", "unmapped", "unmapped_percent", "n_one_one", "one_hit_one_library", "n_many_one", "multiple_hits_one_library",
        "n_one_many", "one_hit_multiple_libraries", "n_many_many", "multiple_hits_multiple_libraries",
    ]
    rows = read_screen_table(spark, path, names).withColumn("sample", stem(F.col("file")) if sample is None else sample)
    grouped = rows.groupBy("sample", "file", "version").agg(F.array_sort(F.collect_list(F.struct("line", *names))).alias("organisms"))
    first = F.col("organisms")[0]
    return grouped.select("sample", "version", "organisms", *[first[c].alias(c) for c in ("library", "one_hit_one_library", "multiple_hits_one_library", "one_hit_multiple_libraries")])


def read_screen_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table of a screening tool: a version line, a header line, rows of a name and numbers up to the first empty row."""
    lines = spark.read.text(path, wholetext=True)
    body = F.element_at(F.split("value", r"\n[ \t]*\n"), 1)
    rows = lines.select(F.input_file_name().alias("file"), F.element_at(F.split("value", "\n"), 1).alias("version"), F.posexplode(F.split(body, "\n")).alias("line", "row"))
    cells = F.split("row", "\t")
    return rows.filter("line > 1 and trim(row) <> ''").select(
        "file", "version", "line", F.get(cells, F.lit(0)).alias(columns[0]), *[F.get(cells, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns) if i]
    )
