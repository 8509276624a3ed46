"""A third of all rows on one key: results stay whole and no stored step piles up in one task."""

import pytest
from pyspark.sql import functions as F

from trapline.functions.missing import ascending
from trapline.operators.clusters import cluster_points
from trapline.operators.order import with_row_id
from trapline.operators.rollup import host_pathogen, median_by
from trapline.operators.spatial import region_studies, region_studies_text, studies_by_region

ROWS = 60_000


@pytest.fixture(scope="module")
def assays(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, ROWS, 1, 16).select(
        F.col("id").alias("unique_id"),
        F.when(hot, "Hot").otherwise(F.concat(F.lit("C"), (F.col("id") % 50).cast("string"))).alias("country"),
        F.lit("N").alias("iso3c"),
        F.when(hot, "Rat").otherwise("Mouse").alias("classification"),
        F.lit("Lassa").alias("pathogen_clean"),
        F.lit("pcr_positive").alias("assay"),
        F.lit(1).cast("bigint").alias("number"),
        F.lit(2).cast("bigint").alias("samples_tested"),
        (F.col("id") * 7919 % 10_007).cast("double").alias("value"),
        F.when(hot, 1.5).otherwise(F.col("id") % 97 / 10).alias("lon"),
        F.when(hot, 2.5).otherwise(F.col("id") % 89 / 10).alias("lat"),
    )


def test_rollup_of_a_hot_group(assays):
    hot = host_pathogen(assays).filter("country = 'Hot'").first()
    assert (hot.number_of_studies, hot.number_positive, hot.number_tested) == (ROWS // 3, ROWS // 3, 2 * ROWS // 3)


def test_median_of_a_hot_group(assays):
    values = sorted(float(i * 7919 % 10_007) for i in range(0, ROWS, 3))
    expected = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    medians = dict(median_by(assays, "classification", "value").collect())
    assert medians["Rat"] == expected


def test_clusters_of_a_hot_spot(assays):
    per_zoom = cluster_points(assays, (0, 9)).groupBy("zoom").agg(F.max("number"), F.sum("number"))
    found = {r[0]: (r[1], r[2]) for r in per_zoom.collect()}
    assert found[0] == (ROWS, ROWS) and found[9][0] >= ROWS // 3 and found[9][1] == ROWS


def test_study_list_of_a_hot_region_is_whole(assays):
    seen = region_studies(assays.withColumn("ord", F.col("unique_id")), "country", "unique_id", "ord")
    counts = {r.country: (r.n, r.n_studies) for r in studies_by_region(seen, "country", "unique_id").collect()}
    assert counts["Hot"] == (ROWS // 3, ROWS // 3) and len(counts) == 51
    listed = region_studies_text(seen, "country", "unique_id", ["Hot"]).first().studies
    assert listed.split(", ") == [str(i) for i in range(0, ROWS, 3)]


def test_numbering_spreads_a_hot_key(spark, assays, monkeypatch):
    from trapline.operators import order

    stored = []
    monkeypatch.setattr(order, "settle", lambda df: stored.append(df) or real(df))
    real = __import__("trapline.session", fromlist=["settle"]).settle
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = with_row_id(assays.select("country", "unique_id"), ascending("country", "unique_id"))
        assert numbered.agg(F.max("id"), F.count_distinct("id")).first() == (ROWS, ROWS)
        sizes = [r["count"] for r in stored[0].groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 4 and max(sizes) < ROWS / 3


def test_a_hot_group_of_a_large_table_is_added_up_in_several_tasks(spark, assays, tmp_path, monkeypatch):
    from trapline import session
    from trapline.operators import rollup

    one = assays.withColumns({"unique_id": F.lit(None).cast("bigint"), "country": F.lit("Hot"), "classification": F.lit("Rat")})
    one.withColumn("number", F.col("value").cast("bigint")).write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    expected = host_pathogen(stored).collect()
    monkeypatch.setattr(session, "PART_BYTES", 1_000)
    assert host_pathogen(stored).collect() == expected and expected[0].number_of_studies == 1
    keys = ["unique_id", *rollup.ROLLUP_KEYS]
    added = rollup._added_up(stored.select(*keys, "number"), keys, [F.sum("number").alias("n")], [F.sum("n").alias("n")], 64)
    assert added.collect()[0].n == expected[0].number_positive
    assert "__lane" in added._jdf.queryExecution().executedPlan().toString().split("hashpartitioning")[2]
