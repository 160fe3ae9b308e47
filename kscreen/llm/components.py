"""Connected components of a link table, as rounds of joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kscreen.llm.common import read_back, remove, store


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of any ordered type. Returns (v, label) for every vertex of a link; label is the least vertex reachable.

    Each round gives a vertex the least of itself and its neighbours, then its label's label until
    no label changes, so labels halve their distance each time. A link's ends are then replaced by
    their labels; links inside a label have done their work and go, and of equal ones one stays. So
    of many links among the same vertices only those between labels are joined again. It ends when
    no link is left. Of the vertices that are left after two rounds each stands for two or more.
    Every join has a vertex once on one side, so that the engine can split one with very many links.
    """
    spark = links.sparkSession
    edges = _between(links)
    edges = read_back(edges, edges_path := store(edges, "edges"))
    steps: list[tuple[DataFrame, str]] = []
    while not steps or edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label"), F.lit(True).alias("changed"))
        step = read_back(step, path := store(step, "labels"))
        while step.filter("changed").limit(1).count():
            far = step.select("v", F.col("label").alias("via")).join(step.select(F.col("v").alias("via"), "label"), "via")
            far = far.select("v", "label", (F.col("label") < F.col("via")).alias("changed"))
            old = path
            step = read_back(far, path := store(far, "labels"))
            remove(spark, old)
        steps.append((step, path))
        left = edges.join(step.select(F.col("v").alias("a"), F.col("label").alias("to_a")), "a")
        left = left.join(step.select(F.col("v").alias("b"), F.col("label").alias("to_b")), "b")
        left, old = _between(left.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), edges_path
        edges = read_back(left, edges_path := store(left, "edges"))
        remove(spark, old)
    labels = steps[0][0].select("v", "label")
    for step, _ in steps[1:]:
        labels = labels.join(step.select(F.col("v").alias("label"), F.col("label").alias("last")), "label", "left").select("v", F.coalesce("last", "label").alias("label"))
    if len(steps) > 1:
        labels = read_back(labels, store(labels, "labels"))
        remove(spark, *[path for _, path in steps])
    remove(spark, edges_path)
    return labels


def _between(links: DataFrame) -> DataFrame:
    """Links of two different vertices, the lesser first, each once."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
