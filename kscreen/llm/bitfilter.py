"""A bit table of keys in the shared folder, read by the Python workers that need it.

It has at most MAX_BITS bits whatever the number of keys; beyond that more keys pass by chance,
which costs traffic but never changes a result, as every use of it is followed by an exact step.
"""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kscreen.llm.common import store
from kscreen.llm.token_store import filesystem

#: 16 bits or more for each key, as a power of two between these.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
#: Tables that a Python worker holds at once; no operator's task needs more.
LOADED = 4
_SHIFTS = (0, 31)
_LOADED: dict[str, np.ndarray] = {}


class BitFilter:
    """Made from a table of distinct long keys; picklable."""

    def __init__(self, keys: DataFrame, col: str, count: int):
        self.bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * count).bit_length()))
        at = [F.shiftrightunsigned(col, s).bitwiseAND(F.lit(self.bits - 1)) for s in _SHIFTS]
        places = keys.select(F.explode(F.array(*at)).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
        self.path = store(places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")), "filter")

    def _table(self) -> np.ndarray:
        if self.path not in _LOADED:
            system, at = filesystem(self.path)
            t = pq.read_table(at, filesystem=system)
            words = np.zeros(self.bits >> 6, np.int64)
            words[t.column("word").to_numpy()] = t.column("bits").to_numpy()
            while len(_LOADED) >= LOADED:
                _LOADED.pop(next(iter(_LOADED)))
            _LOADED[self.path] = words.view(np.uint64)
        return _LOADED[self.path]

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys may be in the table: all that are, and few others."""
        keys, table = keys.view(np.uint64), self._table()
        ok = np.ones(len(keys), bool)
        for shift in _SHIFTS:
            at = keys >> np.uint64(shift) & np.uint64(self.bits - 1)
            ok &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok
