"""Every checked query against its SQL, and totals that must agree between queries."""

import importlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fixtures.catalog import CATALOG, HOSTS, TABLE_ROWS, ZOOMS
from fixtures.views import Survey
from trapline.operators.rollup import distinct_by
from trapline.operators.spatial import join_points_in_regions
from trapline.plans import associations, microbes, sites

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database(small_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{small_dir}/{table}.parquet'")
    return connection


@pytest.fixture
def survey(spark, small_dir):
    return Survey.open(spark, small_dir)


def in_order(columns, data):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(row[i] for i in places)) for row in data)


WITH_SQL = {name for name, (_, sql) in CATALOG.items() if sql}


@pytest.mark.parametrize("name", sorted(WITH_SQL))
def test_query_equals_its_sql(spark, small_dir, database, name):
    query, sql = CATALOG[name]
    result, expected = query(spark, small_dir), database.sql(sql)
    assert sorted(result.columns) == sorted(expected.columns)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: kinds[t] for c, t in result.dtypes} == types
    assert in_order(result.columns, result.collect()) == in_order(expected.columns, expected.fetchall())


def test_entry_points(spark):
    module = importlib.import_module("__spark_entry__")
    own = {name for name in module.queries() if name in CATALOG}
    assert own == set(CATALOG) and WITH_SQL <= set(module.oracle_sql()) <= set(module.queries())
    assert own - WITH_SQL == {"detection_markers"}  # compared with a plain loop in test_clusters
    result = module.entry(spark)
    assert tuple(result.columns) == associations.TABLE_COLUMNS and result.count() > 0


def test_tested_animals_add_up_over_the_selected_rows(survey):
    table = associations.host_pathogen_table(survey.pathogen, HOSTS, ["All"])
    chosen = table.filter(F.col("id").isin(TABLE_ROWS))
    borders = survey.level_0
    by_country = associations.tested_per_country(survey.pathogen, borders, TABLE_ROWS, HOSTS, ["All"])
    total = F.sum("number_tested")
    assert by_country.agg(total).first()[0] == chosen.agg(total).first()[0] > 0


def test_row_ids_are_dense(survey):
    table = associations.host_pathogen_table(survey.pathogen)
    low, high, n = table.agg(F.min("id"), F.max("id"), F.count("id")).first()
    assert (low, high) == (1, n)


def test_region_counts_add_up_to_the_hits(survey):
    hits = join_points_in_regions(survey.spatial.select("ord", "lon", "lat"), survey.level_2, "region_id")
    density = sites.site_density_by_region(survey.level_2, survey.spatial)
    assert density.agg(F.sum("n")).first()[0] == hits.count()


def test_clusters_count_every_point_at_every_zoom(survey):
    n = microbes.detections(survey.pathogen).count()
    totals = microbes.detection_clusters(survey.pathogen, ZOOMS).groupBy("zoom").agg(F.sum("number"))
    assert dict(totals.collect()) == {z: n for z in ZOOMS}


def test_base_layer_has_one_marker_per_coordinate(survey):
    assert sites.base_layer(survey.spatial).count() == distinct_by(survey.spatial, ["lon", "lat"]).count()
