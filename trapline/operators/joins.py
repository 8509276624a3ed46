"""Joins in which a missing key matches a missing key.

No broadcast is forced: Catalyst broadcasts a side whose estimated size is below
``spark.sql.autoBroadcastJoinThreshold``, AQE does so once it knows the real size, and beyond it the
equi-join is shuffled, with skewed partitions split by AQE.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame


def _same(left: DataFrame, right: DataFrame, pairs: Mapping[str, str]) -> Column:
    tests = [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]
    return reduce(Column.__and__, tests)


def left_join_na(
    left: DataFrame, right: DataFrame, on: str | Sequence[str] | Mapping[str, str]
) -> DataFrame:
    """Left join keeping the left key columns once. ``on`` maps left names to right names."""
    if isinstance(on, str):
        on = [on]
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    marked = {b: f"__r_{b}" for b in pairs.values()}
    right = right.withColumnsRenamed(marked)
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides, drop or rename one: {sorted(clash)}")
    condition = _same(left, right, {a: marked[b] for a, b in pairs.items()})
    return left.join(right, condition, "left").drop(*marked.values())


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``."""
    marked = {c: f"__k_{c}" for c in on}
    right = keys.select(*on).withColumnsRenamed(marked)
    return df.join(right, _same(df, right, marked), "left_semi")
