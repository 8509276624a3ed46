"""Physical plans of every checked query, including the steps stored on the way."""

import re
import sys

import pytest
from pyspark.sql import functions as F

from fixtures.catalog import CATALOG
from fixtures.views import VIEWS

FORBIDDEN = (
    "BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroups",
    "CartesianProduct", "BroadcastNestedLoopJoin",
)
# Where all rows of a step may meet in one task: one total per partition of a sorted table, the
# head of a top-k, one line of text about the selected rows, or one row count per task.
BOUNDED = ("keys=[__part", "TakeOrderedAndProject", "position#", "keys=[], functions=[partial_count(1)]")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, small_dir):
    from trapline import session

    real, found = session.settle, {}
    with pytest.MonkeyPatch.context() as patch:
        stored = []

        def record(df):
            stored.append(plan(df))
            return real(df)

        for module in [m for name, m in sys.modules.items() if name.startswith("trapline.") and hasattr(m, "settle")]:
            patch.setattr(module, "settle", record)
        for name, (query, _) in CATALOG.items():
            stored.clear()
            result = plan(query(spark, small_dir))
            found[name] = [*stored, result]
    return found


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_no_python_and_no_pairwise_joins(plans, name):
    for text in plans[name]:
        for operator in FORBIDDEN:
            assert operator not in text, f"{name} uses {operator}"


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_only_bounded_rows_meet_in_one_task(plans, name):
    for text in plans[name]:
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                below = "\n".join(lines[i + 1 : i + 3])
                assert any(mark in below for mark in BOUNDED), f"{name}:\n{text}"


def test_scans_read_only_the_columns_in_use(plans):
    text = "\n".join(plans["habitat_counts"])
    schema = re.search(r"ReadSchema: struct<(l_[^>]*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_linenumber", "l_partkey"]


def test_choices_reach_the_scan(spark, tmp_path, small_dir):
    from fixtures.views import Survey
    from trapline.sources.tables import laid_out
    from trapline.operators.spatial import join_points_in_regions
    from trapline.plans import associations
    from trapline.sources.tables import conform, table_schema
    from trapline.survey import open_survey, store_prepared

    source = Survey.open(spark, small_dir)
    tables = {"species": source._view(VIEWS["fx_species"]).withColumn("presence_absence", F.lit("Presence"))}
    tables |= {"pathogen": source.raw_pathogen, "rodent_summary": source.rodent_summary, "spatial": source.spatial}
    tables |= {"studies": source.studies, "studies_all": source.studies, "level_0": source.level_0, "level_2": source.level_2}
    for name, table in tables.items():
        conform(table, table_schema(name), name).write.parquet(f"{tmp_path}/raw/{name}.parquet")
    recorded = open_survey(spark, f"{tmp_path}/raw")
    store_prepared(recorded, f"{tmp_path}/clean")
    survey = open_survey(spark, f"{tmp_path}/clean", prepared=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(associations._rollup(survey.pathogen, ["Red bolt"], ["Brand#3"], associations.PREPARED))
    assert "EqualTo(classification,Red bolt)" in text and "EqualTo(pathogen_clean,Brand#3)" in text
    assert "lon" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "regexp_replace" not in text
    # From raw names, labels are made above the first aggregate only.
    raw = spark.read.parquet(f"{tmp_path}/raw/pathogen.parquet")
    text = plan(associations._rollup(raw, ["Red bolt"], ["Brand#3"], associations.RAW))
    assert "regexp_replace" not in text[text.rindex("HashAggregate") :]
    assert sorted(associations._rollup(raw, ["Red bolt"], None, associations.RAW).collect(), key=str) == sorted(
        associations._rollup(survey.pathogen, ["Red bolt"], None, associations.PREPARED).collect(), key=str
    )
    points = survey.pathogen.select("ord", "lon", "lat")
    text = plan(join_points_in_regions(points, survey.level_2, "region_id"))
    assert "GreaterThanOrEqual(lon,-360.0)" in text and "LessThanOrEqual(lat,90.0)" in text
    assert "Exchange hashpartitioning" not in text


def test_first_rows_are_compared_only_where_they_lead(plans):
    for text in plans["first_assay_per_coordinate"]:
        below = [line for line in text.splitlines() if "Scan" in line or "LeftSemi" in line]
        assert any("LeftSemi" in line for line in below)


def test_selection_follows_the_page(spark, small_dir):
    from fixtures.views import Survey
    from trapline.sources.tables import laid_out
    from trapline.plans.studies import selected_studies, short_study_table

    table = Survey.open(spark, small_dir).studies.select("unique_id", "year_published", "title")
    sort = [F.col("year_published").desc_nulls_last()]
    page = [r.unique_id for r in short_study_table(table, order=sort, limit=40).collect()]
    for parts in (1, 3, 16):
        chosen = selected_studies(table.repartition(parts), range(1, 41), sort)
        assert [r.unique_id for r in chosen.orderBy("position").collect()] == page


def test_assays_of_large_tables_are_joined_over_more_partitions(spark, small_dir, monkeypatch):
    import re

    from fixtures.views import Survey
    from trapline.sources.tables import laid_out
    from trapline import session

    expected = Survey(spark, small_dir).raw_pathogen
    monkeypatch.setattr(session, "PART_BYTES", 2_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = Survey(spark, small_dir).raw_pathogen
        parts = session.more_parts(raw)
        plan = raw._jdf.queryExecution().executedPlan().toString()
        for key in ("l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "l_partkey", "p_partkey"):
            assert re.search(rf"hashpartitioning\({key}#\d+L?, {parts}\)", plan), key
        assert sorted(map(str, raw.collect())) == sorted(map(str, expected.collect()))
        assert laid_out(raw.select("ord", "country"), ["country", "ord"]).rdd.getNumPartitions() == parts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
