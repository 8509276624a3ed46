import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trapline.operators.clusters import TILE, cell_degrees, cluster_markers


def one_by_one(points, zooms):
    """Clusters by a plain loop over all markers."""
    markers = {}
    for spot, n in Counter(points).items():
        markers[spot] = (n, spot[0] * n, spot[1] * n)
    out = {}
    for zoom in sorted(zooms, reverse=True):
        reach = cell_degrees(zoom)

        def turn(spot):
            cx, cy = math.floor(spot[0] / (reach * TILE)), math.floor(spot[1] / (reach * TILE))
            return cx % 2 + 2 * (cy % 2), cy, cx, spot

        order, centre_of = sorted(markers, key=turn), {}
        for spot in order:
            if spot in centre_of:
                continue
            for other in order:
                if other not in centre_of and (spot[0] - other[0]) * (spot[0] - other[0]) + (spot[1] - other[1]) * (spot[1] - other[1]) <= reach * reach:
                    centre_of[other] = spot
        joined = {}
        for spot, centre in centre_of.items():
            joined[centre] = tuple(a + b for a, b in zip(joined.get(centre, (0, 0.0, 0.0)), markers[spot]))
        markers = joined
        for centre, (n, x, y) in joined.items():
            out[zoom, *centre] = (n, x / n, y / n)
    return out


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7)])
def test_equals_one_marker_after_the_other(spark, seed, parts):
    pick = random.Random(seed)
    centres = [(pick.uniform(-20, 20), pick.uniform(-10, 20)) for _ in range(6)]
    points = [(round(pick.gauss(x, 1.5), 2), round(pick.gauss(y, 1.5), 2)) for x, y in centres for _ in range(60)]
    points += [(3.25, 4.5)] * 200 + [(0.0, 0.0), (-0.0, 0.0), (180.0, 90.0), (-180.0, -90.0)]
    points = [(x + 0.0, y + 0.0) for x, y in points]
    df = spark.createDataFrame([*points, (None, 1.0), (1.0, None)], "lon double, lat double").repartition(parts)
    found = {(r.zoom, r.lon, r.lat): (r.number, r.mean_lon, r.mean_lat) for r in cluster_markers(df, (3, 5, 8)).collect()}
    expected = one_by_one(points, (3, 5, 8))
    assert found.keys() == expected.keys() and {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in expected.items()}
    for key, (_, x, y) in found.items():
        assert (x, y) == pytest.approx(expected[key][1:])
    for zoom in (3, 5, 8):
        assert sum(v[0] for k, v in found.items() if k[0] == zoom) == len(points)


def test_a_hot_coordinate_and_no_points(spark):
    df = spark.range(0, 30_000, 1, 6).select(F.lit(1.5).alias("lon"), F.when(F.col("id") % 3 == 0, 2.5).otherwise(2.5 + F.col("id") % 7 / 1000).alias("lat"))
    rows = cluster_markers(df, (2, 9)).collect()
    assert [r.number for r in rows] == [30_000, 30_000]
    assert cluster_markers(df.limit(0), (3,)).count() == 0
