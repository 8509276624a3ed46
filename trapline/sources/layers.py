"""Map layers: points and regions, ready to draw.

A point layer that is looked at through map views is stored along a space-filling curve (``store_points``): points close on the map are
close in the files. A view's box becomes a few ranges of the curve, these become ranges of folders, and only those are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.operators.order import with_row_id

FOLDER_POINTS = 50_000  # points per folder of a stored layer
CURVE_BITS = 20  # steps of each axis: 2**20 over the whole map, about 40 m
VIEW_RANGES = 64  # ranges of the curve that a box is turned into, at most
_KEY, _ROW, _FOLDER = "__key", "__row", "__folder"
_POINT_COLUMNS = ["lon", "lat", "colour", "radius", "popup", "layer"]


def point_layer(
    df: DataFrame, layer: str, colour: Column, radius: int, popup: Column | None = None
) -> DataFrame:
    """Points with position, colour, radius, label and layer name; unplaced rows are left out."""
    label = popup if popup is not None else F.lit(None).cast("string")
    return df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        "lon",
        "lat",
        colour.alias("colour"),
        F.lit(radius).alias("radius"),
        label.alias("popup"),
        F.lit(layer).alias("layer"),
    )


def region_layer(
    df: DataFrame,
    layer: str,
    region_id: str,
    value: Column,
    value_class: Column,
    label: Column,
    ring: str | None = "ring",
) -> DataFrame:
    """Regions with value, class, label and, if kept, their outline."""
    outline = [F.col(ring).alias("ring")] if ring else []
    return df.select(
        F.col(region_id).alias("region"),
        value.alias("value"),
        value_class.alias("class"),
        label.alias("label"),
        F.lit(layer).alias("layer"),
        *outline,
    )


def _write(df: DataFrame, path: str, form: str, mode: str) -> None:
    if form not in ("parquet", "json"):
        raise ValueError(f"layer format must be parquet or json, not {form!r}")
    df.write.mode(mode).format(form).save(path)


def write_points(df: DataFrame, path: str, form: str = "parquet", mode: str = "error") -> None:
    """Store a point layer as Parquet, or as one JSON object per line."""
    _write(df.select(*_POINT_COLUMNS), path, form, mode)


def write_regions(df: DataFrame, path: str, form: str = "parquet", mode: str = "error") -> None:
    """Store a region layer as Parquet, or as one JSON object per line."""
    columns = ["region", "value", "class", "label", "layer"]
    kept = columns + [c for c in ("ring",) if c in df.columns]
    _write(df.select(*kept), path, form, mode)


def _steps(value: Column, low: float, width: float) -> Column:
    step = F.floor((value - low) / width * (1 << CURVE_BITS))
    return F.least(F.greatest(step, F.lit(0)), F.lit((1 << CURVE_BITS) - 1)).cast("bigint")


def _spread(value: Column) -> Column:
    """The bits of a number with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def curve_key(lon: Column, lat: Column) -> Column:
    """Place of a point on the curve: the bits of its steps east and north in turn."""
    return _spread(_steps(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_steps(lat, -90.0, 180.0)), 1))


def box_ranges(west: float, south: float, east: float, north: float, most: int = VIEW_RANGES) -> list[tuple[int, int]]:
    """Ranges of the curve, ends included, that hold all points of a box, and few others.

    Squares that the box cuts are quartered, the largest first, until there are ``most`` of them.
    """
    whole = [(0, 0.0, 0.0, CURVE_BITS)]  # first place on the curve, steps east and north, size in bits
    scale = float(1 << CURVE_BITS)
    low_x, high_x = (west + 180) / 360 * scale, (east + 180) / 360 * scale
    low_y, high_y = (south + 90) / 180 * scale, (north + 90) / 180 * scale

    def meets(x: float, y: float, size: float) -> bool:
        return (x <= high_x or x == 0) and (x + size >= low_x or x + size == scale) and (y <= high_y or y == 0) and (y + size >= low_y or y + size == scale)

    done = []
    while whole and len(whole) + len(done) < most:
        place, x, y, bits = whole.pop(0)
        size = float(1 << bits)
        if bits == 0 or low_x <= x and x + size <= high_x and low_y <= y and y + size <= high_y:
            done.append((place, x, y, bits))
            continue
        half = size / 2
        for quarter in range(4):
            corner = (x + half * (quarter & 1), y + half * (quarter >> 1))
            if meets(*corner, half):
                whole.append((place + (quarter << 2 * (bits - 1)), *corner, bits - 1))
    ranges: list[tuple[int, int]] = []
    for place, _, _, bits in sorted(whole + done):
        last = place + (1 << 2 * bits) - 1
        if ranges and ranges[-1][1] + 1 == place:
            ranges[-1] = (ranges[-1][0], last)
        else:
            ranges.append((place, last))
    return ranges


def store_points(df: DataFrame, path: str, folder_points: int = FOLDER_POINTS, mode: str = "error") -> None:
    """Store a point layer along the curve, for ``open_points``. Points at one spot may fill several folders."""
    points = df.select(*_POINT_COLUMNS).withColumn(_KEY, curve_key(F.col("lon"), F.col("lat")))
    tie = F.xxhash64(*_POINT_COLUMNS)
    numbered = with_row_id(points, [F.col(_KEY), F.col("lon"), F.col("lat"), tie], _ROW)
    laid = numbered.withColumn(_FOLDER, F.floor((F.col(_ROW) - 1) / folder_points)).drop(_ROW)
    laid.write.mode(mode).partitionBy(_FOLDER).parquet(f"{path}/points")
    stored = df.sparkSession.read.parquet(f"{path}/points")
    ends = stored.groupBy(_FOLDER).agg(F.min(_KEY).alias("first"), F.max(_KEY).alias("last"))
    ends.coalesce(1).write.mode(mode).parquet(f"{path}/folders")


@dataclass(frozen=True)
class PointLayer:
    """A point layer stored along the curve: its points, and the first and last place of each folder."""

    points: DataFrame
    folders: DataFrame

    def _held(self, boxes: list[tuple[float, float]], south: float, north: float) -> list[tuple[int, int, int, int]]:
        """First and last folder, first and last place, of every range of the curve that the boxes meet and the layer has points in."""
        ranges = [r for west, east in boxes for r in box_ranges(west, south, east, north)]
        # Two numbers per range, whatever the size of the layer.
        inside = [F.when((F.col("last") >= low) & (F.col("first") <= high), F.col(_FOLDER)) for low, high in ranges]
        ends = self.folders.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(inside) for n, f in (("low", F.min), ("high", F.max))]).first()
        return [(ends[f"low{i}"], ends[f"high{i}"], *r) for i, r in enumerate(ranges) if ends[f"low{i}"] is not None]

    def in_box(self, west: float, south: float, east: float, north: float) -> DataFrame:
        """The points of a map view, its edges included. A view with ``west`` > ``east`` lies across the date line."""
        boxes = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
        held = self._held(boxes, south, north)
        if not held:
            return self.points.limit(0).drop(_KEY, _FOLDER)
        folders = reduce(Column.__or__, [F.col(_FOLDER).between(a, b) for a, b, _, _ in held])
        keys = reduce(Column.__or__, [F.col(_KEY).between(low, high) for _, _, low, high in held])
        inside = reduce(Column.__or__, [F.col("lon").between(w, e) for w, e in boxes]) & F.col("lat").between(south, north)
        return self.points.filter(folders).filter(keys & inside).drop(_KEY, _FOLDER)


def open_points(spark: SparkSession, path: str) -> PointLayer:
    """A layer that ``store_points`` wrote."""
    return PointLayer(spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/folders"))
