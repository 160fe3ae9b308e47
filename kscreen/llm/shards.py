"""Longest-processing-time sharding.

Groups that must stay together, sorted by size, go to the least-loaded shard through a heap.
The heap runs on the driver over a bounded list: groups above a grain (the mean shard's size
over GRAINS) are listed one by one, at most shards x GRAINS of them; smaller groups are first
packed, in their own tasks and by size, into parcels of about one grain. Loads then differ by about the
size of a parcel, one part in GRAINS of a shard, unless a single group is larger than that.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kscreen.llm.common import read_back, remove, store, written

#: Grains in a mean shard. The driver sees at most 3 x shards x GRAINS items and one a task.
GRAINS = 4096


def lpt_plan(items: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Item -> shard: largest first, each to the least-loaded shard (the lowest number among equals)."""
    heap, plan = [(0, s) for s in range(n_shards)], {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        plan[name] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return plan


def _parcels(grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            size = b.column(1).to_numpy()
            small = size < grain
            ends = at + np.cumsum(np.where(small, size, 0))
            at = int(ends[-1]) if len(ends) else at
            item = np.where(small, np.char.add(f"p{part}-", ((ends - size) // grain).astype(str)).astype(object), b.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(item, pa.string())], ["_group", "_bytes", "_item"])

    return run


def lpt_shards(df: DataFrame, group_cols: list[str], size: Column, n_shards: int, keep: dict[str, Column]) -> DataFrame:
    """One row for each row of df: keep's columns, size, shard (int) and slot (long, gapless from 0 in a shard).

    Rows with equal values in group_cols share a shard (null equals null and, for texts, empty).
    size: a long of at least 1. Any of df's columns may be null; df's other columns are not read,
    whatever their names. Groups of equal size are taken in the order of their hashes; repeated rows
    share a shard and have slots of their own; texts are only hashed, so very long ones cost no
    more than their bytes. An empty df gives no rows. A shard's rows can be written with
    ``write_shards``.
    """
    spark = df.sparkSession
    group = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group_cols]).cast("binary"), 256)
    rows = written(df.select(*[c.alias(k) for k, c in keep.items()], size.cast("long").alias("size"), group.alias("_group")), "shard-rows")
    totals = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    grain = max(1, total // (n_shards * GRAINS))
    totals = totals.sortWithinPartitions(F.desc("_bytes"), "_group")
    groups = written(totals.mapInArrow(_parcels(grain), "_group string, _bytes long, _item string"), "shard-groups")
    items = [(r[0], r[1]) for r in groups.groupBy("_item").agg(F.sum("_bytes")).toLocalIterator()]
    plan = lpt_plan(items, n_shards)
    plan_df = spark.createDataFrame(pa.table({"_item": pa.array(list(plan), pa.string()), "shard": pa.array(list(plan.values()), pa.int32())}))
    places = groups.join(plan_df, "_item").select("_group", "shard")
    places = read_back(places, places_path := store(places, "shard-places"))
    # both sides are plain scans, so that a group of very many rows can be split by the engine
    placed = rows.join(places, "_group").drop("_group").sortWithinPartitions("shard")
    placed = placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    placed = written(placed, "shard-placed")
    # one row for each shard and task; whether it is small enough to broadcast is for the engine to see
    firsts = placed.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = firsts.select("shard", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    shifts = read_back(shifts, shifts_path := store(shifts, "shard-shifts"))
    out = written(placed.join(shifts, ["shard", "_part"]).select(*keep, "size", "shard", (F.col("_at") + F.col("_shift")).alias("slot")), "shard-slots")
    remove(spark, places_path, shifts_path)
    return out


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder a shard."""
    placed.write.partitionBy("shard").parquet(path)
