"""Levels of a category column and their colours, taken from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.operators.order import with_row_id


def levels_of(df: DataFrame, column: str) -> DataFrame:
    """``column`` and ``level``: its known values in order, numbered from 1.

    Levels are the categories of a legend, numbered over the distinct values alone.
    """
    known = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return with_row_id(known, [F.col(column).asc()], "level")


def with_level_colour(
    df: DataFrame, column: str, levels: DataFrame, palette: Sequence[str], name: str = "colour"
) -> DataFrame:
    """``df`` with the palette entry of each value's level; a missing value has none.

    With more levels than entries the palette starts anew, so that neighbours in order differ.
    """
    entries = F.array(*[F.lit(p) for p in palette])
    colour = F.element_at(entries, (F.pmod(F.col("level") - 1, F.lit(len(palette))) + 1).cast("int"))
    coloured = levels.select(column, colour.alias(name))
    return df.join(coloured, column, "left").select(*df.columns, name)
