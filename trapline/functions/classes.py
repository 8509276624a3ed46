"""Fixed-break classes and category colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_of(column: Column, breaks: Sequence[float]) -> Column:
    """1-based class over ``[a, b)`` intervals, the last one closed; outside is missing."""
    last = len(breaks) - 1
    result = None
    for i in range(1, last + 1):
        low, high = F.lit(float(breaks[i - 1])), F.lit(float(breaks[i]))
        inside = (column >= low) & ((column <= high) if i == last else (column < high))
        result = F.when(inside, F.lit(i)) if result is None else result.when(inside, F.lit(i))
    return result


def class_label(number: Column, breaks: Sequence[float]) -> Column:
    """Legend text of a class number."""
    names = [f"{low:.3f} to {high:.3f}" for low, high in zip(breaks, breaks[1:])]
    return F.coalesce(*[F.when(number == i, F.lit(n)) for i, n in enumerate(names, start=1)])


def recode_levels(column: Column, domain: Sequence[str], palette: Sequence[str]) -> Column:
    """Palette entry of each value by its place in the sorted domain; others are missing."""
    levels = sorted(set(domain))
    if len(levels) > len(palette):
        raise ValueError(f"{len(levels)} levels but only {len(palette)} palette entries")
    result = F.lit(None).cast("string")
    for level, colour in reversed(list(zip(levels, palette))):
        result = F.when(column == F.lit(level), F.lit(colour)).otherwise(result)
    return result
