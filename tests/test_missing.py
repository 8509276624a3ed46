from pyspark.sql import functions as F

from trapline.functions.missing import (
    ascending,
    contains_text,
    is_one_of,
    is_reported,
    lacks_text,
    n_distinct_or_missing,
    number_text,
    sum_or_missing,
    text_or_na,
)
from trapline.operators.joins import left_join_na, semi_join
from trapline.operators.rollup import count_by, distinct_by


def test_missing_text_contains_nothing_and_is_kept_by_the_negation(evaluate):
    values = ["pcr_tested", "pcr", None]
    assert evaluate(values, "string", lambda c: contains_text(c, "tested")) == [True, False, False]
    assert evaluate(values, "string", lambda c: lacks_text(c, "tested")) == [False, True, True]


def test_sum_is_missing_when_a_summand_is(rows):
    df = rows([("a", 1), ("a", None), ("b", 2), ("b", 3), ("c", None)], "k string, v bigint")
    out = dict(df.groupBy("k").agg(sum_or_missing(F.col("v"))).collect())
    assert out == {"a": None, "b": 5, "c": None}


def test_distinct_count_counts_missing_once(rows):
    df = rows([("a", 1), ("a", None), ("a", None), ("a", 1), ("b", 2), ("c", None)], "k string, v int")
    out = dict(df.groupBy("k").agg(n_distinct_or_missing(F.col("v"))).collect())
    assert out == {"a": 2, "b": 1, "c": 1}


def test_missing_keys_match_in_joins(rows):
    left = rows([(1, "x"), (None, "y"), (3, "z")], "k int, a string")
    right = rows([(1, "p"), (None, "q")], "k int, b string")
    assert sorted(left_join_na(left, right, "k").select("a", "b").collect()) == [
        ("x", "p"), ("y", "q"), ("z", None),
    ]
    assert sorted(semi_join(left, right, ["k"]).select("a").collect()) == [("x",), ("y",)]


def test_join_renames_the_right_key_and_refuses_clashes(rows):
    left = rows([("N1", 5)], "iso3c string, n int")
    right = rows([("N1", "one")], "gid_0 string, name_0 string")
    joined = left_join_na(left, right, {"iso3c": "gid_0"})
    assert joined.columns == ["iso3c", "n", "name_0"]
    assert joined.collect() == [("N1", 5, "one")]
    try:
        left_join_na(left, right.withColumn("n", F.lit(1)), {"iso3c": "gid_0"})
    except ValueError as error:
        assert "n" in str(error)
    else:
        raise AssertionError("clash not reported")


def test_sort_and_group_keep_missing_last(rows):
    df = rows([("b",), (None,), ("B",), ("a",)], "k string")
    assert [r.k for r in df.orderBy(*ascending("k")).collect()] == ["B", "a", "b", None]
    assert {r.k: r.number for r in count_by(df, "k").collect()} == {"b": 1, None: 1, "B": 1, "a": 1}


def test_reported_drops_missing_and_the_text_na(evaluate):
    assert evaluate(["NA", None, "farm"], "string", is_reported) == [False, None, True]


def test_text_shows_na(evaluate):
    assert evaluate(["x", None], "string", text_or_na) == ["x", "NA"]
    assert evaluate([120, None], "bigint", text_or_na) == ["120", "NA"]


def test_whole_numbers_print_without_decimals(evaluate):
    values = [120.0, 100000.0, 12345678.0, 1.5, None]
    assert evaluate(values, "double", number_text) == ["120", "100000", "12345678", "1.5", None]


def test_membership_is_never_missing(evaluate):
    values = ["a", "b", None]
    assert evaluate(values, "string", lambda c: is_one_of(c, ["a"])) == [True, False, False]
    assert evaluate(values, "string", lambda c: is_one_of(c, [])) == [False, False, False]
    assert evaluate(values, "string", lambda c: is_one_of(c, ["a", None])) == [True, False, True]


def test_distinct_treats_missing_values_as_equal(rows):
    df = rows([(None, 1), (None, 1), ("a", None), ("a", None)], "k string, v int")
    assert distinct_by(df, ["k", "v"]).count() == 2
