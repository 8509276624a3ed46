"""Missing-value rules of the survey tables, as column expressions.

In survey data a missing value is a value of its own: it matches itself in joins and membership
tests, counts as one distinct value, makes a sum missing, sorts last and prints as ``NA``. Spark's
defaults differ on every point, so operators go through these helpers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.constants import MISSING_TEXT


def contains_text(column: Column, text: str) -> Column:
    """True where ``column`` contains ``text``; a missing value contains nothing."""
    return F.coalesce(column.contains(text), F.lit(False))


def lacks_text(column: Column, text: str) -> Column:
    """Negation of :func:`contains_text`; keeps rows whose value is missing."""
    return column.isNull() | ~column.contains(text)


def sum_or_missing(column: Column) -> Column:
    """Sum that is missing as soon as one summand is."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def n_distinct_or_missing(column: Column) -> Column:
    """Distinct count in which the missing value, if present, counts once."""
    return F.count_distinct(column) + F.max(column.isNull().cast("int"))


def matches_any(column: Column, values: Iterable) -> Column:
    """Membership test for filters, in a form that reaches the file scan.

    A missing value matches only if it is listed; otherwise its test is missing, which a filter
    takes for false. Do not negate it; negate :func:`is_one_of`.
    """
    values = list(values)
    listed = [v for v in values if v is not None]
    if len(listed) == len(values):
        return column.isin(listed) if listed else F.lit(False)
    return column.isin(listed) | column.isNull() if listed else column.isNull()


def is_one_of(column: Column, values: Iterable) -> Column:
    """Membership test that is never missing."""
    return F.coalesce(matches_any(column, values), F.lit(False))


def is_reported(column: Column) -> Column:
    """Neither missing nor the text ``NA``."""
    return column != F.lit(MISSING_TEXT)


def number_text(column: Column) -> Column:
    """A numeric column as text; whole numbers print without a decimal part or exponent."""
    whole = F.floor(column)
    return F.when(column == whole, whole.cast("string")).otherwise(column.cast("string"))


def text_or_na(column: Column) -> Column:
    """Value as text, with ``NA`` for a missing one."""
    return F.coalesce(column.cast("string"), F.lit(MISSING_TEXT))


def ascending(*columns: str) -> list[Column]:
    """Ascending sort keys with missing values last."""
    return [F.col(c).asc_nulls_last() for c in columns]
