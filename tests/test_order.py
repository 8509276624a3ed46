import random

import pytest
from pyspark.sql import functions as F

from trapline.functions.missing import ascending
from trapline.operators.order import (
    order_by_count,
    rank_by_frequency,
    rows_at,
    stack_extents,
    with_row_id,
    with_running_total,
)
from trapline.operators.rollup import count_by, first_row_by, median_by


def test_row_ids_follow_the_order_over_many_partitions(spark):
    numbers = spark.range(0, 20_000, 1, 13).select((F.col("id") * 7919 % 20_011).alias("v"))
    out = with_row_id(numbers, [F.col("v").asc()]).collect()
    expected = {v: i + 1 for i, v in enumerate(sorted(x * 7919 % 20_011 for x in range(20_000)))}
    assert {r.v: r.id for r in out} == expected


def test_row_ids_put_missing_last(rows):
    df = rows([(None, 1), ("b", 2), ("a", 3)], "k string, v int")
    assert {r.k: r.id for r in with_row_id(df, ascending("k")).collect()} == {"a": 1, "b": 2, None: 3}


def test_row_ids_of_an_empty_table(rows):
    assert with_row_id(rows([], "k string"), ascending("k")).count() == 0


def test_running_total(spark):
    weights = [random.Random(5).randrange(10) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(weights)), "k int, w bigint").repartition(9)
    out = {r.k: r.total for r in with_running_total(df, ascending("k"), "w", "total").collect()}
    total = 0
    for k, w in enumerate(weights):
        total += w
        assert out[k] == total


def test_rows_at_positions(spark):
    df = spark.range(0, 5_000, 1, 7).select((F.col("id") * 31 % 5_003).alias("v"))
    wanted = [1, 2, 77, 4_000, 9_999, 0, -3]
    head = sorted(rows_at(df, [F.col("v").asc()], wanted).collect())
    assert [r.id for r in sorted(head, key=lambda r: r.id)] == [1, 2, 77, 4_000]
    assert rows_at(df, [F.col("v").asc()], []).count() == 0


def test_frequency_rank_and_its_reverse(rows):
    df = rows([("b",)] * 3 + [("a",)] * 3 + [("c",)] * 5 + [(None,)] * 9, "k string")
    counts = count_by(df, "k")
    assert dict(rank_by_frequency(counts, "k").collect()) == {"c": 1, "a": 2, "b": 3}
    assert dict(rank_by_frequency(counts, "k", reverse=True).collect()) == {"c": 3, "a": 2, "b": 1}


def test_counts_sort_descending_with_ties_in_key_order(rows):
    df = rows([("b", 2), ("a", 2), (None, 2), ("c", 9)], "k string, number bigint")
    assert [r.k for r in order_by_count(df, "k").collect()] == ["c", "a", "b", None]


def test_first_fill_level_is_stacked_on_top(rows):
    df = rows([(1, "a", 2), (1, "b", 3), (2, "a", 4), (1, None, 1)], "x int, fill string, number bigint")
    out = {(r.x, r.fill): (r.y_min, r.y_max) for r in stack_extents(df, "x", "fill").collect()}
    assert out == {(1, None): (0, 1), (1, "b"): (1, 4), (1, "a"): (4, 6), (2, "a"): (0, 4)}


def test_median_against_brute_force_with_a_hot_key(spark):
    pick = random.Random(3)
    data = [("hot", pick.choice([1.0, 2.0, 2.5, 1e6])) for _ in range(2_001)]
    data += [(pick.choice("abcd"), pick.uniform(-5, 5)) for _ in range(999)]
    data += [(None, 1.0), (None, 3.0), ("empty", None), ("one", 4.0), ("one", None)]
    out = dict(median_by(spark.createDataFrame(data, "k string, v double").repartition(8), "k", "v").collect())
    expected = {}
    for key in {k for k, _ in data}:
        values = sorted(v for k, v in data if k == key and v is not None)
        if values:
            m = len(values)
            expected[key] = (values[(m - 1) // 2] + values[m // 2]) / 2
    assert out == expected


def test_first_row_is_the_same_for_any_partitioning(spark):
    pick = random.Random(11)
    data = [(pick.randrange(40), pick.randrange(9), pick.choice(["x", "y", None])) for _ in range(4_000)]
    df = spark.createDataFrame(data, "ord int, k int, t string")
    results = [
        sorted(first_row_by(df.repartition(n), ["k"], ["ord"]).collect()) for n in (1, 3, 16)
    ]
    assert results[0] == results[1] == results[2]

    def rank(row):
        return (row[0], row[2] is not None, row[2] or "")

    expected = {k: min((r for r in data if r[1] == k), key=rank) for k in range(9)}
    assert {r.k: (r.ord, r.k, r.t) for r in first_row_by(df, ["k"], ["ord"]).collect()} == expected


def test_first_row_with_missing_keys_and_orders(rows):
    data = [(None, "a", 5), (None, "a", 4), (1, "a", 1), (2, None, 9), (1, None, 3), (None, None, 8)]
    df = rows(data, "ord int, k string, v int")
    out = {r.k: (r.ord, r.v) for r in first_row_by(df, ["k"], ["ord"]).collect()}
    assert out == {"a": (None, 4), None: (None, 8)}
