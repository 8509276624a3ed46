import math
import random

import pytest
from pyspark.sql import functions as F

from trapline.functions.sphere import EARTH_RADIUS_M, ring_area_m2
from trapline.operators.spatial import (
    join_points_in_regions,
    region_cells,
    region_studies,
    region_studies_text,
    sites_by_region,
    studies_by_region,
)
from trapline.plans.sites import density_layer, site_density_by_region, studies_in_regions

REGION = "region_id string, name_2 string, ring array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def as_regions(spark, shapes, names=None):
    data = [
        (key, (names or {}).get(key, key), [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings])
        for key, rings in shapes.items()
    ]
    return spark.createDataFrame(data, REGION)


def as_points(spark, points):
    return spark.createDataFrame(
        [(i, float(x) if x is not None else None, float(y) if y is not None else None)
         for i, (x, y) in enumerate(points)],
        "ord bigint, lon double, lat double",
    ).repartition(5)


def hits(df):
    return sorted((r.ord, r.region_id) for r in df.collect())


def unit(x, y):
    x, y = math.radians(x), math.radians(y)
    return math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)


def inside(rings, x, y):
    """Closed point-in-polygon test by side of each edge's plane, one edge at a time; for regions that hold no pole."""
    odd, (px, py, pz) = False, unit(x, y)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (x, y) == (x1, y1) or x1 == x2 == x and min(y1, y2) <= y <= max(y1, y2):
                return True
            (ax, ay, az), (bx, by, bz) = unit(x1, y1), unit(x2, y2)
            side = px * (ay * bz - az * by) + py * (az * bx - ax * bz) + pz * (ax * by - ay * bx)
            if (x1 > x) != (x2 > x) and (side < 0) == (x2 > x1):
                odd = not odd
    return odd


@pytest.mark.parametrize("limit", [128 * 1024 * 1024, 0])
def test_boundaries_are_closed_and_holes_and_gaps_are_out(spark, limit):
    shapes = {
        "left": [box(0, 0, 2, 2)],
        "right": [box(2, 0, 4, 2)],
        "holed": [box(10, 10, 14, 14), box(11, 11, 13, 13)[::-1]],
        "parts": [box(20, 0, 21, 1), box(22, 0, 23, 1)],
    }
    points = [
        (1, 1), (2, 1), (0, 0), (2, 2), (4, 2), (5, 1),
        (10.5, 12), (12, 12), (11, 12), (13, 13), (20.5, 0.5), (21.5, 0.5), (22.5, 0.5), (23, 1),
        (None, 1), (1, None), (float("nan"), 1), (float("inf"), 1), (1e300, 1),
    ]
    expected = [
        (0, "left"), (1, "left"), (1, "right"), (2, "left"), (3, "left"), (3, "right"), (4, "right"),
        (6, "holed"), (8, "holed"), (9, "holed"), (10, "parts"), (12, "parts"), (13, "parts"),
    ]
    found = join_points_in_regions(
        as_points(spark, points), as_regions(spark, shapes), "region_id", broadcast_bytes=limit
    )
    assert hits(found) == sorted(expected)


def star(pick, x, y, size, corners):
    angles = sorted(pick.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [
        (x + size * pick.uniform(0.3, 1) * math.cos(a), y + size * pick.uniform(0.3, 1) * math.sin(a))
        for a in angles
    ]
    return ring + ring[:1]


def test_random_regions_of_all_sizes_against_brute_force(spark):
    pick = random.Random(17)
    shapes = {}
    for i in range(40):
        size = 10 ** pick.uniform(-3, 1.3)
        x, y = pick.uniform(-20, 20), pick.uniform(-20, 20)
        rings = [star(pick, x, y, size, pick.randrange(3, 60))]
        if i % 4 == 0:
            rings.append(star(pick, x, y, size / 5, 7))
        if i % 5 == 0:
            rings.append(star(pick, x + 3 * size, y, size / 2, 9))
        shapes[f"r{i}"] = rings
    points = [(pick.uniform(-25, 25), pick.uniform(-25, 25)) for _ in range(600)]
    for rings in shapes.values():
        corners = rings[0]
        cx, cy = corners[0]
        points += corners[:3]
        points += [(cx + pick.gauss(0, 0.01), cy + pick.gauss(0, 0.01)) for _ in range(8)]
    expected = sorted(
        (i, key) for i, (x, y) in enumerate(points) for key, rings in shapes.items() if inside(rings, x, y)
    )
    assert len(expected) > 300
    regions, sites = as_regions(spark, shapes), as_points(spark, points)
    assert hits(join_points_in_regions(sites, regions, "region_id")) == expected
    assert hits(join_points_in_regions(sites, regions, "region_id", broadcast_bytes=0)) == expected


def ring_at(lat, start=0.0, step=30):
    """Ring round the earth, eastwards, without and with longitudes beyond 180 degrees."""
    corners = [(start + i, lat) for i in range(0, 360, step)]
    return corners + corners[:1]


def test_edges_are_arcs_of_great_circles(spark):
    shapes = {"north": [[(-30, 40), (30, 40), (30, 60), (-30, 60), (-30, 40)]], "south": [[(-30, 20), (30, 20), (30, 40), (-30, 40), (-30, 20)]]}
    top = math.degrees(math.atan(math.tan(math.radians(40)) / math.cos(math.radians(30))))
    points = [(0, 40), (0, 42), (0, top - 1e-9), (0, top + 1e-9), (0, 61), (29.9, 40.001), (30, 40), (0, 21)]
    found = hits(join_points_in_regions(as_points(spark, points), as_regions(spark, shapes), "region_id"))
    assert top > 44 and found == [
        (0, "south"), (1, "south"), (2, "south"), (3, "north"), (4, "north"), (5, "south"), (6, "north"), (6, "south")
    ]


@pytest.mark.parametrize("by", [0, 175.5, 187.25, -190])
def test_shifting_round_the_earth_changes_nothing(spark, by):
    pick = random.Random(23)
    shapes = {f"r{i}": [star(pick, pick.uniform(-15, 15), pick.uniform(-60, 60), pick.choice([0.5, 4, 20]), pick.randrange(3, 20))] for i in range(25)}
    points = [(round(pick.uniform(-30, 30) * 1024) / 1024, round(pick.uniform(-70, 70) * 1024) / 1024) for _ in range(700)]
    shapes = {k: [[(round(x * 1024) / 1024 + 1 / 4096, y) for x, y in r] for r in rings] for k, rings in shapes.items()}
    expected = [(i, key) for i, (x, y) in enumerate(points) for key, rings in shapes.items() if inside(rings, x, y)]
    turned = {k: [[((x + by + 180) % 360 - 180, y) for x, y in r] for r in rings] for k, rings in shapes.items()}
    moved = [(x + by, y) for x, y in points]
    regions = as_regions(spark, turned)
    assert len(expected) > 100 and hits(join_points_in_regions(as_points(spark, moved), regions, "region_id")) == sorted(expected)
    areas = dict(regions.select("region_id", ring_area_m2("ring")).collect())
    still = dict(as_regions(spark, shapes).select("region_id", ring_area_m2("ring")).collect())
    assert areas == pytest.approx(still, rel=1e-9)
    cells = dict(region_cells(regions, "region_id").groupBy("region_id").count().collect())
    assert max(cells.values()) < 3_000


def test_regions_round_the_poles(spark):
    closed = [(-180.0, -75.0), *[(float(x), -75.0) for x in range(-150, 180, 30)], (180.0, -75.0), (180.0, -90.0), (-180.0, -90.0), (-180.0, -75.0)]
    shapes = {
        "cap": [ring_at(70)], "west": [ring_at(70, 10)[::-1]], "belt": [ring_at(60), ring_at(80, 5)], "south": [ring_at(-65, -170)],
        "drawn": [closed],
    }
    points = [(0, 90), (77, 89), (-179, 71.9), (180, 72), (15, 70.1), (50, 61.9), (50, 85), (-180, -66), (33, -90), (100, -64), (0, 0), (200, -80)]
    found = hits(join_points_in_regions(as_points(spark, points), as_regions(spark, shapes), "region_id"))
    expected = {
        0: ["cap", "west"], 1: ["cap", "west"], 2: ["cap", "west", "belt"], 3: ["cap", "west", "belt"], 4: ["belt"], 5: ["belt"], 6: ["cap", "west"],
        7: ["south"], 8: ["south", "drawn"], 9: [], 10: [], 11: ["south", "drawn"],
    }
    assert found == sorted((i, r) for i, names in expected.items() for r in names)

    def cap(lat, step=30):
        k, a = math.tan(math.radians(90 - lat) / 2) ** 2, math.radians(step)
        return 360 / step * 2 * math.atan2(k * math.sin(a), 1 + k * math.cos(a)) * EARTH_RADIUS_M**2

    areas = dict(as_regions(spark, shapes).select("region_id", ring_area_m2("ring")).collect())
    expected = {"cap": cap(70), "west": cap(70), "belt": cap(60) - cap(80), "south": cap(65), "drawn": cap(75)}
    assert areas == pytest.approx(expected, rel=1e-9)


def test_the_date_line_as_a_border(spark):
    shapes = {"west": [box(170, 0, 180, 10)], "east": [box(-180, 0, -170, 10)], "both": [box(175, 20, 185, 30)]}
    points = [(180, 5), (-180, 5), (179, 5), (-179, 5), (180, 25), (175, 25), (-175, 25), (184.5, 25), (-175.5, 25), (0, 5), (180, 0), (540 - 360, 10)]
    found = hits(join_points_in_regions(as_points(spark, points), as_regions(spark, shapes), "region_id"))
    assert found == sorted(
        [(0, "west"), (0, "east"), (1, "west"), (1, "east"), (2, "west"), (3, "east"), (4, "both"), (5, "both"), (6, "both"), (7, "both"),
         (8, "both"), (10, "west"), (10, "east"), (11, "west"), (11, "east")]
    )


def test_cells_per_region_are_bounded_whatever_its_size(spark):
    shapes = {"half": [box(-89, -80, 89, 80)], "cap": [ring_at(60)], "yard": [box(1, 1, 1.00001, 1.00001)], "dot": [box(3, 3, 3, 3)]}
    cells = region_cells(as_regions(spark, shapes), "region_id")
    per_region = dict(cells.groupBy("region_id").count().collect())
    assert max(per_region.values()) <= 17 * 17


def test_cells_inside_a_region_need_no_edges(spark):
    ring = [(10 * math.cos(a / 50 * math.pi), 10 * math.sin(a / 50 * math.pi)) for a in range(100)]
    cells = region_cells(as_regions(spark, {"disc": [ring + ring[:1]]}), "region_id")
    sizes = [len(r.edges) for r in cells.collect()]
    assert len(sizes) <= 65 * 65
    assert sizes.count(0) > len(sizes) / 3 and max(sizes) < 60


def test_a_spot_holding_a_third_of_all_rows(spark):
    shapes = {"a": [box(0, 0, 1, 1)], "b": [box(1, 0, 2, 1)], "c": [box(5, 5, 5.25, 5.25)]}
    n = 30_000
    df = spark.range(0, n, 1, 12).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id") % 200 / 100).alias("lon"),
        F.lit(0.25).alias("lat"),
    )
    lon = [0.5 if i % 3 == 0 else i % 200 / 100 for i in range(n)]
    expected = {"a": sum(x <= 1 for x in lon), "b": sum(x >= 1 for x in lon)}
    for limit in (128 * 1024 * 1024, 0):
        found = join_points_in_regions(df, as_regions(spark, shapes), "region_id", broadcast_bytes=limit)
        assert dict(sites_by_region(found, "region_id").collect()) == expected


def test_no_regions_give_no_hits(spark):
    empty = spark.createDataFrame([], REGION)
    found = join_points_in_regions(as_points(spark, [(1, 1)]), empty, "region_id")
    assert found.columns == ["ord", "lon", "lat", "region_id"] and found.count() == 0


def test_studies_are_counted_and_listed_in_first_seen_order(rows):
    data = [("r", "s3", 5), ("r", "s1", 2), ("r", None, 1), ("r", "s3", 0), ("r", "s2", 9), ("q", "s9", 1), ("p", None, 1)]
    seen = region_studies(rows(data, "region string, study string, ord int"), "region", "study", "ord")
    counts = {r.region: (r.n, r.n_studies, r.n_known_studies) for r in studies_by_region(seen, "region", "study").collect()}
    assert counts == {"r": (5, 4, 3), "q": (1, 1, 1), "p": (1, 1, 0)}
    texts = region_studies_text(seen, "region", "study", ["r", "p"])
    assert dict(texts.collect()) == {"r": "s3, NA, s1, s2", "p": "NA"}


def test_a_region_with_thousands_of_studies_is_one_row(spark):
    shapes = {"many": [box(0, 0, 1, 1)], "few": [box(5, 0, 6, 1)], "none": [box(9, 9, 10, 10)]}
    regions = as_regions(spark, shapes, {k: k for k in shapes})
    points = [(0.1 + i % 80 / 100, 0.5) for i in range(2_500)] + [(5.5, 0.5)]
    sites = as_points(spark, points).withColumn("unique_id", F.concat(F.lit("s"), F.col("ord").cast("string")))
    density = site_density_by_region(regions, sites)
    assert density.count() == 3
    found = {r.region_id: (r.n, r.n_studies) for r in density.collect()}
    assert found == {"many": (2_500, 2_500), "few": (1, 1), "none": (None, None)}
    seen = studies_in_regions(regions, sites)
    texts = region_studies_text(seen, "region_id", "unique_id", ["many"])
    assert texts.first().studies == ", ".join(f"s{i}" for i in range(2_500))
    layer = {r.region: r.label for r in density_layer(density, texts).collect()}
    assert set(layer) == {"many", "few"} and layer["many"].endswith("s2499") and "Studies" not in layer["few"]


def test_few_cell_widths_serve_regions_of_all_sizes(spark):
    pick = random.Random(4)
    shapes = {}
    for i in range(400):
        x, y, size = pick.uniform(-150, 150), pick.uniform(-60, 60), 10 ** pick.uniform(-2, 1.3)
        shapes[f"r{i}"] = [box(x, y, x + size, y + size)]
    cells = region_cells(as_regions(spark, shapes), "region_id")
    assert cells.select("scale").distinct().count() <= 6


def test_density_by_id_and_by_shared_name(spark):
    shapes = {"r1": [box(0, 0, 1, 1)], "r2": [box(5, 0, 6, 1)], "r3": [box(9, 9, 10, 10)]}
    regions = as_regions(spark, shapes, {"r1": "Same", "r2": "Same", "r3": "Alone"})
    sites = as_points(spark, [(0.5, 0.5), (0.6, 0.5), (5.5, 0.5), (50, 50)]).withColumn(
        "unique_id", F.concat(F.lit("s"), F.col("ord").cast("string"))
    )
    by_id = {r.region_id: r for r in site_density_by_region(regions, sites).collect()}
    assert {k: (r.n, r.n_studies) for k, r in by_id.items()} == {"r1": (2, 2), "r2": (1, 1), "r3": (None, None)}
    assert by_id["r3"].sites_per_km2 is None and by_id["r3"].density_class is None
    assert by_id["r1"].sites_per_km2 == pytest.approx(2 / (by_id["r1"].area_m2 / 1e6))
    assert by_id["r1"].density_class == 1
    by_name = site_density_by_region(regions, sites, group="name_2")
    assert {r.region_id: (r.n, r.n_studies) for r in by_name.collect()} == {"r1": (3, 3), "r2": (3, 3), "r3": (None, None)}
    shown = density_layer(site_density_by_region(regions, sites)).collect()
    assert sorted(r.region for r in shown) == ["r1", "r2"]
