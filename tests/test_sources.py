import json

import pytest
from pyspark.sql import functions as F

from trapline.functions.geometry import ring_from_wkt
from trapline.sources import paging
from trapline.sources.borders import load_borders, write_borders
from trapline.sources.layers import box_ranges, open_points, point_layer, region_layer, store_points, write_points, write_regions
from trapline.sources.paging import open_pages, store_pages, table_page
from trapline.sources.tables import (
    load_regions,
    load_table,
    table_schema,
    union_regions,
    with_file_order,
    with_lon_lat,
)


def test_declared_tables_load_and_missing_columns_are_named(spark, tmp_path, rows):
    data = rows([("mus", "mus_minutoides", "farm", 1)], "genus string, classification string, trap_habitat string, extra int")
    data.write.parquet(f"{tmp_path}/rodent_summary.parquet")
    loaded = load_table(spark, str(tmp_path), "rodent_summary")
    assert loaded.schema == table_schema("rodent_summary")
    assert loaded.collect() == [("mus", "mus_minutoides", "farm")]
    data.drop("genus").write.mode("overwrite").parquet(f"{tmp_path}/rodent_summary.parquet")
    with pytest.raises(ValueError, match="genus"):
        load_table(spark, str(tmp_path), "rodent_summary")
    with pytest.raises(KeyError, match="unknown table"):
        table_schema("nothing")


def test_declared_types_are_applied(spark, tmp_path, rows):
    rows([(1, 2)], "k int, v int").write.parquet(f"{tmp_path}/t.parquet")
    assert load_table(spark, str(tmp_path), "t", "v bigint, k string").collect() == [(2, "1")]


def test_region_tables_stack_by_name(spark, tmp_path, rows):
    a = rows([("a", 1)], "name_2 string, n int")
    b = rows([(2, "b")], "n int, name_2 string")
    assert sorted(union_regions([a, b]).collect()) == [("a", 1), ("b", 2)]
    a.write.parquet(f"{tmp_path}/countries/A")
    b.write.parquet(f"{tmp_path}/countries/B")
    schema = a.schema
    assert sorted(load_regions(spark, f"{tmp_path}/countries", schema).collect()) == [("a", 1), ("b", 2)]


def test_points_from_text(rows):
    df = rows([(1, "POINT (-13.25 8.5)"), (2, "point( 1 -2.5 )"), (3, "LINESTRING (0 0, 1 1)"), (4, None)], "i int, geometry string")
    out = {r.i: (r.lon, r.lat) for r in with_lon_lat(df).collect()}
    assert out == {1: (-13.25, 8.5), 2: (1.0, -2.5), 3: (None, None), 4: (None, None)}


def test_layers_are_stored_as_parquet_and_json(spark, tmp_path, rows):
    points = point_layer(rows([(1.0, 2.0), (None, 2.0)], "lon double, lat double"), "Layer", F.lit("black"), 3)
    for form in ("parquet", "json"):
        write_points(points, f"{tmp_path}/p_{form}", form)
        stored = spark.read.format(form).load(f"{tmp_path}/p_{form}").collect()
        assert [(r.lon, r.lat, r.colour, r.radius, r.layer) for r in stored] == [(1.0, 2.0, "black", 3, "Layer")]
    ring = "array(array(named_struct('x', 0d, 'y', 0d), named_struct('x', 1d, 'y', 0d)))"
    table = rows([("r", 1.5)], "id string, v double").selectExpr("*", f"{ring} as ring")
    regions = region_layer(table, "Areas", "id", F.col("v"), F.lit("c"), F.lit("label"))
    write_regions(regions, f"{tmp_path}/r")
    stored = spark.read.parquet(f"{tmp_path}/r").first()
    assert (stored.region, stored.value, stored["class"], len(stored.ring[0])) == ("r", 1.5, "c", 2)
    with pytest.raises(ValueError):
        write_points(points, f"{tmp_path}/x", "csv")


@pytest.fixture
def table(spark):
    return spark.range(0, 205, 1, 6).select(
        F.concat(F.lit("id"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("unique_id"),
        (F.col("id") % 7).alias("year"),
        F.when(F.col("id") % 2 == 0, "Zoonoses Risk").alias("aim"),
    )


def test_pages_are_disjoint_and_complete(table):
    sort = [F.col("year").desc()]
    seen = []
    for page in range(6):
        seen += [r.unique_id for r in table_page(table, "unique_id", order=sort, offset=page * 40, limit=40).collect()]
    whole = [r.unique_id for r in table.orderBy(F.col("year").desc(), "unique_id").collect()]
    assert seen == whole


def test_page_filters_and_search(table):
    def ids(**options):
        return [r.unique_id for r in table_page(table, "unique_id", limit=500, **options).collect()]

    assert ids(column_filters={"aim": "zoonoses r"}) == [f"id{i:03}" for i in range(0, 205, 2)]
    assert ids(column_filters={"year": (2, 3)}) == [f"id{i:03}" for i in range(205) if i % 7 in (2, 3)]
    assert ids(column_filters={"year": (None, 0)}) == [f"id{i:03}" for i in range(0, 205, 7)]
    assert ids(column_filters={"aim": [None], "year": [1]}) == [f"id{i:03}" for i in range(205) if i % 7 == 1 and i % 2]
    assert ids(search="RISK id00") == [f"id{i:03}" for i in range(0, 10, 2)]


@pytest.fixture
def stored(table, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "BLOCK_ROWS", 10)
    store_pages(table, f"{tmp_path}/pages", "unique_id", [F.col("year").desc()], 50)
    return open_pages(table.sparkSession, f"{tmp_path}/pages", 50)


def test_stored_pages_are_those_of_the_table(table, stored):
    sort = [F.col("year").desc()]
    whole = [r.unique_id for r in table.orderBy(*sort, "unique_id").collect()]
    assert [r.unique_id for p in range(6) for r in stored.page(offset=p * 40, limit=40).collect()] == whole
    assert stored.page(offset=300).count() == 0 and stored.columns == table.columns
    for options in (
        {"column_filters": {"aim": "zoonoses r"}}, {"column_filters": {"year": (2, 3)}, "search": "id1"}, {"search": "RISK id00"},
        {"search": "5"}, {"search": "id10 1"}, {"search": "nowhere"}, {"search": "oses ri isk"},
    ):
        for offset, limit in ((0, 5), (7, 30), (40, 100)):
            plain = table_page(table, "unique_id", order=sort, offset=offset, limit=limit, **options).collect()
            assert stored.page(offset=offset, limit=limit, **options).collect() == plain
    assert [(r.unique_id, r.position) for r in stored.at([205, 3, 51, 0, 999]).orderBy("position").collect()] == [
        (whole[p - 1], p) for p in (3, 51, 205)
    ]


def test_a_deep_page_reads_one_folder(stored):
    for offset in (0, 160):
        plan = stored.page(offset=offset, limit=10)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(__folder" in plan or "PartitionFilters: [__folder" in plan
        files = {r[0].split("__folder=")[1].split("/")[0] for r in stored.rows.filter(F.col("__folder") == offset // 50).select("_metadata.file_path").distinct().collect()}
        assert files == {str(offset // 50)}
        assert "Window" not in plan and "Exchange hash" not in plan


def test_search_blocks_hold_all_matches_and_leave_out_others(table, stored):
    blocks = stored._blocks("id123").collect()
    assert 1 <= len(blocks) < 6
    assert [r.unique_id for r in stored.matches(search="id123").collect()] == ["id123"]
    assert stored._blocks("12 3") is None


def test_search_index_holds_the_trigrams_of_the_words_of_each_block(table, stored):
    expected = set()
    for row in stored.rows.collect():
        text = " ".join(str(row[c]) for c in stored.columns if row[c] is not None).lower()
        expected |= {(w[i : i + 3], (row["__row"] - 1) // 10) for w in text.split(" ") for i in range(len(w) - 2)}
    found = [(r.trigram, r.block) for r in stored.trigrams.collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_search_index_counts_letters_not_bytes(spark, tmp_path):
    store_pages(spark.createDataFrame([("a", "Übung 😀é\u2003x yz"), ("b", None)], "k string, v string"), f"{tmp_path}/p", "k")
    pages = open_pages(spark, f"{tmp_path}/p")
    for search, keys in (("übu", ["a"]), ("BUNG 😀é", ["a"]), ("😀é x", ["a"]), ("ngx", [])):
        assert [r.k for r in pages.page(search=search).collect()] == keys


FEATURES = [
    {"type": "Feature", "properties": {"GID_0": "AAA", "NAME_0": "A, \"quoted\""}, "geometry": {"type": "Polygon", "coordinates": [
        [[0, 0], [4.25, 0], [4.25, 1e-7], [0, 4], [0, 0]], [[1, 0.5, 9], [2, 0.5, 9], [1, 1, 9], [1, 0.5, 9]]]}},
    {"type": "Feature", "properties": {"GID_0": "BBB"}, "geometry": {"type": "MultiPolygon", "coordinates": [
        [[[10, 0], [11, 0], [11, 1], [10, 0]]], [[[20, 0], [24, 0], [24, 4], [20, 0]], [[22, 0.5], [23, 0.5], [23, 1], [22, 0.5]]]]}},
    {"type": "Feature", "properties": {"GID_0": "open"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}},
    {"type": "Feature", "properties": {"GID_0": "short"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]}},
    {"type": "Feature", "properties": {"GID_0": "point"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
    {"type": "Feature", "properties": {"GID_0": "none"}, "geometry": None},
    {"type": "Feature", "properties": {"GID_0": "bad"}, "geometry": {"type": "Polygon", "coordinates": "text"}},
    {"type": "Feature", "properties": {"GID_0": "half"}, "geometry": {"type": "Polygon", "coordinates": [[[0], [1], [1], [0]]]}},
]
RINGS = {
    "AAA": [[(0, 0), (4.25, 0), (4.25, 1e-7), (0, 4), (0, 0)], [(1, 0.5), (2, 0.5), (1, 1), (1, 0.5)]],
    "BBB": [[(10, 0), (11, 0), (11, 1), (10, 0)], [(20, 0), (24, 0), (24, 4), (20, 0)], [(22, 0.5), (23, 0.5), (23, 1), (22, 0.5)]],
}


def rings(df):
    return {r.gid_0: r.ring and [[tuple(p) for p in ring] for ring in r.ring] for r in df.collect()}


def test_geojson_borders(spark, tmp_path):
    names = {"GID_0": "gid_0", "NAME_0": "name_0"}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text("\n".join("\x1e" * (i % 2) + json.dumps(f) for i, f in enumerate(FEATURES)) + "\n\nno json\n")
    expected = RINGS | {k: None for k in ("open", "short", "point", "none", "bad", "half")}
    collection = load_borders(spark, f"{tmp_path}/one", names, "geojson")
    assert rings(collection) == expected
    assert {r.gid_0: r.name_0 for r in collection.collect()}["AAA"] == 'A, "quoted"'
    assert rings(load_borders(spark, f"{tmp_path}/lines", names, "geojsonl")) == expected | {None: None}
    with pytest.raises(ValueError):
        load_borders(spark, str(tmp_path), names, "shape")


@pytest.mark.parametrize("form", ["geojson", "geojsonl", "wkt"])
def test_borders_go_out_and_come_back_equal(spark, tmp_path, form):
    data = [(k, "name " + k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in v]) for k, v in RINGS.items()]
    data.append(("digits", "tab\tquote\"", [[{"x": 0.1 + i / 3, "y": 1e-9 * i} for i in (0, 1, 2, 0)]]))
    regions = spark.createDataFrame(data, "gid_0 string, name_0 string, ring array<array<struct<x:double,y:double>>>").repartition(3)
    write_borders(regions, f"{tmp_path}/out", ["gid_0", "name_0"], form)
    back = load_borders(spark, f"{tmp_path}/out", {"gid_0": "gid_0", "name_0": "name_0"}, form)
    assert sorted(back.collect()) == sorted(regions.select("gid_0", "name_0", "ring").collect())


def test_wkt_polygons(evaluate):
    square = "((0 0, 1 0, 1 1, 0 0))"
    ring = [[(0, 0), (1, 0), (1, 1), (0, 0)]]
    good = {
        f"POLYGON {square}": ring, f"  srid=4326; polygon{square} ": ring, "POLYGON Z ((0 0 5, 1 0 5, 1 1 5, 0 0 5))": ring,
        f"MULTIPOLYGON ({square}, {square})": ring * 2, "Polygon((0.0 -0, 1e0 .0,+1. 1,\n0 0))": ring,
        "POLYGON EMPTY": [], "MULTIPOLYGON ZM EMPTY": [],
        "POLYGON (" + "(0 0, " + "1.5 2.5, " * 30_000 + "0 0))": [[(0, 0), *[(1.5, 2.5)] * 30_000, (0, 0)]],
    }
    bad = [
        None, "", "POINT (1 2)", "POLYGON (0 0, 1 0, 1 1, 0 0)", f"POLYGON ({square})", f"MULTIPOLYGON {square}", "POLYGON ((0 0, 1 0, 1 1))",
        "POLYGON ((0 0, 1 0, 0 0))", "POLYGON ((0 0 1 0, 1 1, 0 0))", "POLYGON ((0 0, 1 0,, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 0)",
        "POLYGON ((0 0, 1 x, 1 1, 0 0))", "POLYGON ((0 0, 1, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 0)) more", "POLYGON ((0 0, 1e999 0, 1 1, 0 0))",
    ]
    found = evaluate([*good, *bad], "string", ring_from_wkt)
    assert [f if f is None else [[tuple(p) for p in r] for r in f] for f in found] == [*good.values(), *[None] * len(bad)]


def test_order_of_files_and_rows_under_any_split(spark, tmp_path):
    rows = spark.range(0, 3_000, 1, 5).select((F.col("id") * 7 % 3_001).alias("v"), F.rand(1).alias("filler"))
    for name in ("b", "a", "c"):
        rows.filter(F.col("v") % 3 == "bac".index(name)).coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/t.parquet/{name}")
    seen = []
    for size in ("128MB", "4KB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/t.parquet")
            seen.append([r.v for r in with_file_order(stored).orderBy("ord").collect()])
            assert sorted(r.ord for r in with_file_order(stored).collect()) == list(range(1, 3_001))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and {v % 3 for v in seen[0][:1_000]} == {1}


def test_tables_without_order_take_that_of_their_files(spark, tmp_path):
    spark.range(3).selectExpr("concat('s', id) as unique_id", "id as n").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert [tuple(r) for r in load_table(spark, str(tmp_path), "t", "ord bigint, unique_id string").orderBy("ord").collect()] == [(1, "s0"), (2, "s1"), (3, "s2")]


@pytest.fixture(scope="module")
def stored_layer(spark, tmp_path_factory):
    lon = (F.col("id") * 7919 % 36_001) / 100 - 180
    lat = F.when(F.col("id") % 3 == 0, 10.5).otherwise((F.col("id") * 104_729 % 18_001) / 100 - 90)
    spots = spark.range(0, 20_000, 1, 5).select(F.when(F.col("id") % 3 == 0, 20.25).otherwise(lon).alias("lon"), lat.alias("lat"), F.col("id").cast("string").alias("popup"))
    layer = point_layer(spots, "l", F.lit("red"), 3, F.col("popup"))
    path = str(tmp_path_factory.mktemp("layer"))
    store_points(layer, path, 500)
    return layer, open_points(spark, path)


@pytest.mark.parametrize("box", [(-10, -10, 30, 30), (20.25, 10.5, 20.25, 10.5), (-180, -90, 180, 90), (170, -20, -170, 20), (5, 5, 6, 6), (100, 89.5, 101, 90), (179.9, -90, 180, 90)])
def test_a_view_has_the_points_of_a_full_filter(stored_layer, box):
    layer, stored = stored_layer
    west, south, east, north = box
    across = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    expected = layer.filter(across & F.col("lat").between(south, north))
    assert sorted(map(tuple, stored.in_box(*box).collect())) == sorted(map(tuple, expected.collect()))


def test_a_view_reads_few_folders(stored_layer):
    _, stored = stored_layer

    def folders(west, south, east, north):
        return {f for a, b, _, _ in stored._held([(west, east)], south, north) for f in range(a, b + 1)}

    assert len(folders(-180, -90, 180, 90)) == 40 and len(folders(100, 20, 110, 30)) <= 6
    assert 13 <= len(folders(20.25, 10.5, 20.25, 10.5)) <= 16 and stored.in_box(20.25, 10.5, 20.25, 10.5).count() == 6_667
    plan = stored.in_box(100, 20, 110, 30)._jdf.queryExecution().executedPlan().toString()
    assert "__folder" in plan.split("PartitionFilters: [")[1].split("]")[0] and "__key" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_ranges_of_a_box():
    assert box_ranges(-180, -90, 180, 90) == [(0, (1 << 40) - 1)]
    for box in ((1, 2, 3, 4), (-180, -90, -179, -89), (-0.5, -0.5, 0.5, 0.5)):
        ranges = box_ranges(*box)
        assert 1 <= len(ranges) <= 64 and all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        assert sum(b - a + 1 for a, b in ranges) < 3 * (box[2] - box[0]) * (box[3] - box[1]) / 360 / 180 * (1 << 40) + 64
