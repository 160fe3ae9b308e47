"""A working folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own if all runs on this machine, as in tests, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kscreen-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
