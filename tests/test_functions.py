import math

import pytest
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.classes import class_label, class_of, recode_levels
from trapline.functions.sphere import EARTH_RADIUS_M, ring_area_m2, site_density
from trapline.functions.text import (
    assay_status,
    effort_label,
    popup_label,
    sentence_case,
    speciation_label,
)


def test_sentence_case(evaluate):
    cases = {
        "mastomys_natalensis": "Mastomys natalensis",
        "Crocidura sp.": "Crocidura sp",
        "RRRStudio x2y": "Rrr studio x 2 y",
        "camelCaseName": "Camel case name",
        "  many---separators__here ": "Many separators here",
        "Brand#12": "Brand 12",
        "ABC": "Abc",
        "été_Chaud": "Été chaud",
        "": "",
        None: None,
    }
    assert evaluate(list(cases), "string", sentence_case) == list(cases.values())


def test_effort_label(evaluate):
    assert evaluate([0, 120, None], "bigint", effort_label) == ["Not reported", "120", None]
    assert evaluate([0.0, 120.0], "double", effort_label) == ["Not reported", "120"]


def test_speciation_label(evaluate):
    values = ["morphological, molecular", "not_reported", None]
    assert evaluate(values, "string", speciation_label) == [
        "Morphological and molecular", "Not reported", None,
    ]


def test_assay_status_takes_the_first_match(evaluate):
    values = ["pcr_tested", "pcr_positive", "tested_positive", "culture", None]
    assert evaluate(values, "string", assay_status) == [
        "Assayed", "Number positive", "Assayed", "Other", "Other",
    ]


def test_popup_label_shows_na_and_double_spaced_dash(spark):
    label = popup_label("Year/month: ", F.lit(2001), K.YEAR_MONTH_GAP, F.lit(None).cast("int"))
    assert spark.range(1).select(label).first()[0] == "Year/month: 2001  -  NA"


def test_classes_are_half_open_and_the_last_is_closed(evaluate):
    breaks = K.DENSITY_BREAKS
    values = [0.0, 0.0009, 0.001, 0.005, 0.01, 0.05, 1.0, 6.0, 6.1, -0.1, None]
    expected = [1, 1, 2, 3, 4, 5, 6, 6, None, None, None]
    assert evaluate(values, "double", lambda c: class_of(c, breaks)) == expected
    names = evaluate([1, 6, None], "int", lambda c: class_label(c, breaks))
    assert names == ["0.000 to 0.001", "1.000 to 6.000", None]


def test_colours_follow_the_sorted_domain(evaluate):
    colours = evaluate(["z", "a", "q", None], "string", lambda c: recode_levels(c, ["z", "a"], ["one", "two"]))
    assert colours == ["two", "one", None, None]
    with pytest.raises(ValueError):
        recode_levels(F.lit("a"), ["a", "b", "c"], ["one", "two"])


def area(spark, rings):
    data = [([[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings],)]
    df = spark.createDataFrame(data, "ring array<array<struct<x:double,y:double>>>")
    return df.select(ring_area_m2("ring")).first()[0]


def test_area_of_an_octant(spark):
    octant = [(0, 0), (90, 0), (0, 90), (0, 0)]
    assert area(spark, [octant]) == pytest.approx(math.pi / 2 * EARTH_RADIUS_M**2, rel=1e-12)


def test_area_subtracts_holes_adds_parts_and_ignores_direction(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    hole = [(0.5, 0.5), (0.5, 1), (1, 1), (1, 0.5), (0.5, 0.5)]
    island = [(5, 0), (6, 0), (6, 1), (5, 1), (5, 0)]
    whole, cut, extra = area(spark, [square]), area(spark, [hole]), area(spark, [island])
    assert area(spark, [square, hole]) == pytest.approx(whole - cut, rel=1e-9)
    assert area(spark, [square, island]) == pytest.approx(whole + extra, rel=1e-9)
    assert area(spark, [square[::-1], hole[::-1]]) == pytest.approx(whole - cut, rel=1e-9)
    assert area(spark, []) == 0.0


@pytest.mark.parametrize("outer_turned", [False, True])
@pytest.mark.parametrize("hole_turned", [False, True])
def test_a_hole_is_subtracted_whatever_its_direction(spark, outer_turned, hole_turned):
    def square(x, y, side, turned=False):
        ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
        return ring[::-1] if turned else ring

    outer, hole, island, part = square(0, 0, 4, outer_turned), square(1, 1, 2, hole_turned), square(1.5, 1.5, 1), square(9, 0, 1)
    one = {name: area(spark, [ring]) for name, ring in zip("ohip", (outer, hole, island, part))}
    assert area(spark, [outer, hole]) == pytest.approx(one["o"] - one["h"], rel=1e-9)
    assert area(spark, [hole, outer]) == pytest.approx(one["o"] - one["h"], rel=1e-9)
    whole = one["o"] - one["h"] + one["i"] + one["p"]
    assert area(spark, [part, island, hole, outer]) == pytest.approx(whole, rel=1e-9)


def test_density_is_missing_without_count_or_area(spark):
    data = [(5, 1_000_000.0), (None, 1_000_000.0), (5, 0.0)]
    df = spark.createDataFrame(data, "n bigint, a double").coalesce(1)
    assert [r[0] for r in df.select(site_density(F.col("n"), F.col("a"))).collect()] == [5.0, None, None]
