"""Counts, distincts and the host-pathogen rollup.

Every aggregate here combines on the map side, so a key that holds most of the rows reaches the
shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.missing import ascending, sum_or_missing
from trapline.operators.choices import filter_not_contains
from trapline.operators.order import with_running_total
from trapline.session import more_parts


ROLLUP_KEYS = ("country", "iso3c", "classification", "pathogen_clean")
_MEASURES = ("number", "samples_tested")
_LANES = 16  # tasks that share the rows of one key, at most


def count_by(df: DataFrame, *keys: str, number: str = "number") -> DataFrame:
    """Row count per key tuple; a missing key is a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(number))


def relabel_counts(
    counts: DataFrame, labels: dict[str, Column], number: str = "number"
) -> DataFrame:
    """Replace key columns of pre-aggregated rows by labels and add up keys that became equal.

    Counting raw values first and labelling the groups afterwards runs the label expressions once
    per group instead of once per row.
    """
    keys = [c for c in counts.columns if c != number]
    return counts.withColumns(labels).groupBy(*keys).agg(F.sum(number).alias(number))


def distinct_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct tuples; missing values are equal to each other."""
    return df.select(*columns).distinct()


def first_row_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole row per key in ``order``, missing values first; the rest of the row breaks ties.

    The best order value per key is found by hashing, from few columns. An equi-join on key and value
    then leaves the rows that hold it, and only these are compared whole. The value is part of the
    join key, so the rows of a hot key spread.
    """
    lead = F.col(order[0])
    best = df.groupBy(*key).agg(
        F.when(~F.max(lead.isNull()), F.min(lead)).alias("__best")
    ).withColumnsRenamed({c: f"__k_{c}" for c in key})
    leads = lead.eqNullSafe(F.col("__best"))
    for c in key:
        leads = F.col(c).eqNullSafe(F.col(f"__k_{c}")) & leads
    rest = [c for c in df.columns if c not in order and c not in key]
    row = F.min(F.struct(*order, *rest)).alias("__row")
    first = df.join(best, leads, "left_semi").groupBy(*key).agg(row)
    return first.select(
        *[F.col(c) if c in key else F.col("__row")[c].alias(c) for c in df.columns]
    )


def _added_up(
    rows: DataFrame, keys: Sequence[str], totals: Sequence[Column], again: Sequence[Column], parts: int | None,
    labels: dict[str, Column] | None = None,
) -> DataFrame:
    """``totals`` of the rows per key, whose raw columns ``labels`` make clean in between; ``again`` adds up rows of ``totals``.

    With ``parts``, rows are dealt over so many partitions, by key and by a lane made from their other values. The rows of one key
    are thus added up in several tasks before they meet.
    """
    if parts is None:
        added = rows.groupBy(*keys).agg(*totals)
        return added.withColumns(labels).groupBy(*keys).agg(*again) if labels else added
    lane = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(_LANES))
    dealt = rows.withColumn("__lane", lane).repartition(parts, *keys, "__lane")
    added = dealt.groupBy(*keys, "__lane").agg(*totals).drop("__lane")
    return (added.withColumns(labels) if labels else added).repartition(parts, *keys).groupBy(*keys).agg(*again)


def host_pathogen(df: DataFrame, labels: dict[str, Column] | None = None) -> DataFrame:
    """Distinct studies, positives and tested samples per country, host and microorganism.

    Rows are added up per study first, which leaves one row per distinct study to count. ``labels`` turn raw key columns into
    their clean form after that, so that a label is made per group and not per row.
    """
    keys = ["unique_id", *ROLLUP_KEYS]
    rows = filter_not_contains(df.select(*keys, "assay", *_MEASURES), "assay", K.TESTED).drop("assay")
    totals = [sum_or_missing(F.col(c)).alias(c) for c in _MEASURES]
    studies = _added_up(rows, keys, totals, totals, more_parts(df), labels)
    return studies.groupBy(*ROLLUP_KEYS).agg(
        F.count(F.lit(1)).alias("number_of_studies"),
        sum_or_missing(F.col("number")).alias("number_positive"),
        sum_or_missing(F.col("samples_tested")).alias("number_tested"),
    )


def study_rollup(df: DataFrame, labels: dict[str, Column] | None = None) -> DataFrame:
    """The host-pathogen rollup one step earlier: per (keys, study) its rows, and of each measure the known values and their sum.

    Such rows add up (``merge_studies``), so they can be stored and joined by those of newer data, and distinct studies stay exact, which
    counts of studies do not. ``labels`` turn raw key columns into their clean form after grouping.
    """
    rows = filter_not_contains(df.select("unique_id", *ROLLUP_KEYS, "assay", *_MEASURES), "assay", K.TESTED)
    totals = [F.count(F.lit(1)).alias("rows")]
    for measure in _MEASURES:
        totals += [F.count(measure).alias(f"known_{measure}"), F.sum(measure).alias(f"sum_{measure}")]
    names = ["rows", *[f"{part}_{m}" for m in _MEASURES for part in ("known", "sum")]]
    again = [F.sum(c).alias(c) for c in names]
    return _added_up(rows.drop("assay"), ["unique_id", *ROLLUP_KEYS], totals, again, more_parts(df), labels)


def merge_studies(parts: DataFrame) -> DataFrame:
    """Rows of one or several study rollups, one per (keys, study)."""
    keys, more = ["unique_id", *ROLLUP_KEYS], more_parts(parts)
    dealt = parts.repartition(more, *keys) if more else parts
    return dealt.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def host_pathogen_of_studies(parts: DataFrame) -> DataFrame:
    """What ``host_pathogen`` gives, from the rows of a study rollup; a study may lie in several of them."""
    measures = {"number": "number_positive", "samples_tested": "number_tested"}
    totals = [
        F.when(F.sum("rows") == F.sum(f"known_{m}"), F.sum(f"sum_{m}")).alias(name) for m, name in measures.items()
    ]
    return merge_studies(parts).groupBy(*ROLLUP_KEYS).agg(F.count(F.lit(1)).alias("number_of_studies"), *totals)


def assay_totals(df: DataFrame, key: str, status: str, number: str = "number") -> DataFrame:
    """Total per (key, status), missing where a summand is."""
    return df.groupBy(key, status).agg(sum_or_missing(F.col(number)).alias(number))


def tested_by_country(table: DataFrame) -> DataFrame:
    """Second-level total of the host-pathogen table per country."""
    return table.groupBy("country", "iso3c").agg(
        sum_or_missing(F.col("number_tested")).alias("number_tested")
    )


def median_by(df: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """Exact median of the known values per key, for groups of any size.

    Equal values are counted first, then a running total over (key, value) shows which rows hold
    the middle positions of each group. No group is ever held in one task.
    """
    counts = count_by(df.filter(F.col(value).isNotNull()), key, value, number="__n")
    spread = with_running_total(counts, ascending(key, value), "__n", "__upto")
    ends = spread.groupBy(key).agg(F.max("__upto").alias("__end"), F.sum("__n").alias("__m"))
    ends = ends.select(
        F.col(key).alias("__key"),
        (F.col("__end") - F.col("__m") + F.floor((F.col("__m") + 1) / 2)).alias("__low"),
        (F.col("__end") - F.col("__m") + F.floor(F.col("__m") / 2) + 1).alias("__high"),
    )
    middle = spread.join(ends, F.col(key).eqNullSafe(F.col("__key"))).filter(
        (F.col("__upto") >= F.col("__low")) & (F.col("__upto") - F.col("__n") < F.col("__high"))
    )
    centre = (F.min(value) + F.max(value)) / 2
    return middle.groupBy(key).agg(centre.alias(name))
