"""Row numbers, running totals and category ranks over data of any size.

A window without ``partitionBy`` sends every row to one task. Here rows are range-sorted instead,
numbered inside their partitions, stored once, and shifted by the totals of the partitions before
theirs. Only one total per partition ever meets in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.missing import ascending
from trapline.session import settle

_PART, _SPOT = "__part", "__spot"
_SPOT_BITS = 33  # monotonically_increasing_id() keeps the row within its partition in these bits


def _sorted_rows(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in global order, with their partition and their place in it, stored once."""
    tag = F.monotonically_increasing_id()
    return settle(df.orderBy(*order).withColumn(_SPOT, tag)).withColumns(
        {
            _PART: F.shiftright(F.col(_SPOT), _SPOT_BITS),
            _SPOT: F.col(_SPOT).bitwiseAND(F.lit((1 << _SPOT_BITS) - 1)),
        }
    )


def _with_offsets(rows: DataFrame, weight: Column, offset: str) -> DataFrame:
    """Attach the total weight of all earlier partitions (one row per partition, so broadcast)."""
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(_PART).agg(F.sum(weight).alias("__total"))
    shifts = totals.select(
        _PART, F.coalesce(F.sum("__total").over(before), F.lit(0).cast("bigint")).alias(offset)
    )
    return rows.join(F.broadcast(shifts), _PART)


def with_row_id(df: DataFrame, order: Sequence[Column], name: str = "id") -> DataFrame:
    """Number rows 1, 2, … in ``order``, which must tell any two rows apart."""
    rows = _with_offsets(_sorted_rows(df, order), F.lit(1).cast("bigint"), "__before")
    number = F.col("__before") + F.col(_SPOT) + 1
    return rows.select(*df.columns, number.alias(name))


def with_running_total(
    df: DataFrame, order: Sequence[Column], weight: str, name: str
) -> DataFrame:
    """Running total of the whole-number column ``weight`` in ``order``, the row included."""
    rows = _with_offsets(_sorted_rows(df, order), F.col(weight), "__before")
    inside = Window.partitionBy(_PART).orderBy(_SPOT).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("__before") + F.sum(weight).over(inside)
    return rows.select(*df.columns, total.alias(name))


def rows_at(
    df: DataFrame, order: Sequence[Column], positions: Sequence[int], name: str = "id"
) -> DataFrame:
    """Rows shown at the given 1-based positions when sorted by ``order``."""
    wanted = sorted({int(p) for p in positions if int(p) > 0})
    return with_row_id(df, order, name).filter(F.col(name).isin(wanted))


def order_by_count(df: DataFrame, key: str, number: str = "number") -> DataFrame:
    """Largest count first; ties in key order, a missing key last."""
    return df.orderBy(F.col(number).desc(), F.col(key).asc_nulls_last())


def rank_by_frequency(
    counts: DataFrame, category: str, number: str = "number", reverse: bool = False,
    name: str = "level_rank",
) -> DataFrame:
    """Rank categories by their total count, most frequent first, ties in text order.

    ``counts`` holds pre-aggregated rows. A missing category is not a level and gets no rank.
    ``reverse`` turns the order round, as a flipped axis shows it.
    """
    totals = (
        counts.filter(F.col(category).isNotNull())
        .groupBy(category)
        .agg(F.sum(number).alias("__n"))
    )
    key, size = F.col(category), F.col("__n")
    order = [size.asc(), key.desc()] if reverse else [size.desc(), key.asc()]
    return with_row_id(totals, order, name).select(category, name)


def rank_by_value(
    levels: DataFrame, category: str, value: str, name: str = "level_rank"
) -> DataFrame:
    """Rank one-row-per-category ``levels`` by ``value`` ascending, missing values last."""
    known = levels.filter(F.col(category).isNotNull()).select(category, value)
    return with_row_id(known, ascending(value, category), name).select(category, name)


def stack_extents(df: DataFrame, x: str, fill: str, number: str = "number") -> DataFrame:
    """Lower and upper end of each stacked bar piece; the first fill level is on top.

    ``df`` holds one row per (x, fill), so a window partition is one bar.
    """
    bar = Window.partitionBy(x).orderBy(F.col(fill).desc_nulls_first())
    top = F.sum(number).over(bar.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"y_max": top, "y_min": top - F.col(number)})
