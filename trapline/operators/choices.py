"""Filters driven by user choices, and the choice lists themselves.

The five choice rules differ on an empty choice and on "All"; keep them apart.

=====================  ======================  ==============================
rule                   empty choice            choice holds "All"
=====================  ======================  ==============================
filter_in              no rows                 "All" is an ordinary value
filter_choice          every row               every row
filter_groups          the default groups      the default groups
filter_host_pathogen   every row if no host    that dimension unfiltered
filter_selected        no rows                 "All" is an ordinary value
=====================  ======================  ==============================
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.missing import is_reported, lacks_text, matches_any
from trapline.operators.joins import semi_join
from trapline.operators.order import with_row_id


def filter_in(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    """Rows whose value is in ``values``; a one-column DataFrame of values becomes a semi-join."""
    if isinstance(values, DataFrame):
        return semi_join(df, values.toDF(column), [column])
    return df.filter(matches_any(F.col(column), values))


def takes_all(values: Sequence | None) -> bool:
    """Whether a choice means "no filter"."""
    return not values or K.ALL in values


def filter_choice(df: DataFrame, column: str | Column, values: Sequence | None) -> DataFrame:
    """Membership filter that an empty choice or "All" switches off."""
    if takes_all(values):
        return df
    target = F.col(column) if isinstance(column, str) else column
    return df.filter(matches_any(target, values))


def filter_groups(
    df: DataFrame, column: str, values: Sequence | None, default: Sequence = K.DEFAULT_GROUPS
) -> DataFrame:
    """Membership filter in which an empty choice or "All" means the default groups."""
    return df.filter(matches_any(F.col(column), default if takes_all(values) else values))


def filter_host_pathogen(
    df: DataFrame,
    hosts: Sequence | None,
    pathogens: Sequence | None,
    host: str = "classification",
    pathogen: str = "pathogen_clean",
) -> DataFrame:
    """Two-way choice. Without any host the whole table is returned, whatever the pathogen."""
    if not hosts:
        return df
    return filter_choice(filter_choice(df, host, hosts), pathogen, pathogens)


def filter_not_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    """Drop rows whose value contains ``text``; keep those whose value is missing."""
    return df.filter(lacks_text(F.col(column), text))


def filter_reported(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose value is missing or the text ``NA``."""
    return df.filter(is_reported(F.col(column)))


def filter_selected(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Membership filter without a sentinel: an empty choice gives no rows."""
    return df.filter(matches_any(F.col(column), values or []))


def value_list(df: DataFrame, column: str) -> list:
    """One column as a Python list. Only for finished choice lists, which a person reads."""
    return [row[0] for row in df.select(column).toLocalIterator()]


def with_sentinel(
    choices: DataFrame, order: Sequence[Column], column: str, label: str | None = K.ALL
) -> DataFrame:
    """Choice list ``(position, choice)`` in ``order``, headed by a sentinel at position 0."""
    listed = with_row_id(choices, order, "position").select(
        "position", F.col(column).cast("string").alias("choice")
    )
    if label is None:
        return listed
    head = choices.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("position"), F.lit(label).alias("choice")
    )
    return head.unionByName(listed)
