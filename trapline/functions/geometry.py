"""Points and polygons as text: WKT and GeoJSON.

Polygons are columns of closed rings of longitude/latitude points: outer rings, each followed by its holes. Text that is no
polygon, has a ring that is not closed or has under four points, or a coordinate that is no finite number, gives a missing value; an
empty polygon has no rings. Heights and measures are read over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.functions.sphere import ring_depths

_POINT = r"(?i)^\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$"
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
RING = "array<array<struct<x:double,y:double>>>"


def point_x(wkt: Column) -> Column:
    """Longitude of a WKT point; missing if the text is not a point."""
    return F.regexp_extract(wkt, _POINT, 1).try_cast("double")


def point_y(wkt: Column) -> Column:
    """Latitude of a WKT point; missing if the text is not a point."""
    return F.regexp_extract(wkt, _POINT, 2).try_cast("double")


def _whole(rings: Column) -> Column:
    """The rings if all are closed, have four points or more and finite coordinates; else missing."""

    def sound(ring: Column) -> Column:
        first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
        finite = F.forall(ring, lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
        return (F.size(ring) >= 4) & (first == last) & finite

    return F.when(F.coalesce(F.forall(rings, sound), F.lit(False)), rings)


def ring_from_wkt(wkt: Column) -> Column:
    """Rings of a WKT polygon or multipolygon, with or without an SRID in front.

    The text's form is checked by folding it up: numbers to points, points to rings, rings to polygons. No pattern repeats a
    group, so that texts of any length can be read.
    """
    text = F.upper(F.regexp_replace(F.regexp_replace(wkt, r"(?i)^\s*SRID\s*=\s*[0-9]+\s*;", ""), r"^\s+|\s+$", ""))
    form = F.regexp_replace(text, _NUMBER, "0")
    form = F.regexp_replace(form, r"0\s+0(?:\s+0)?(?:\s+0)?(?=\s*[,)])", "P")
    form = F.regexp_replace(form, r"^(MULTIPOLYGON|POLYGON)\s*(?:ZM|Z|M)?\s*(?=\()", "$1")
    form = F.regexp_replace(form, r"\s+", "")
    for piece, into in (("P", "R"), ("R", "G")):
        form = F.replace(F.replace(form, F.lit(f",{piece}"), F.lit("")), F.lit(f"({piece})"), F.lit(into))
    form = F.when(form.startswith("MULTIPOLYGON"), F.replace(form, F.lit(",G"), F.lit(""))).otherwise(form)
    points = F.transform(
        F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1),
        lambda ring: F.transform(
            F.split(ring, ","),
            lambda point: F.struct(
                F.get(F.regexp_extract_all(point, F.lit(f"({_NUMBER})"), 1), F.lit(0)).try_cast("double").alias("x"),
                F.get(F.regexp_extract_all(point, F.lit(f"({_NUMBER})"), 1), F.lit(1)).try_cast("double").alias("y"),
            ),
        ),
    )
    empty = text.rlike(r"^(MULTIPOLYGON|POLYGON)\s*(ZM|Z|M)?\s*EMPTY$")
    return F.when(empty, F.array().cast(RING)).when(form.isin("POLYGONG", "MULTIPOLYGON(G)"), _whole(points))


def ring_from_geojson(geometry: Column) -> Column:
    """Rings of a GeoJSON geometry of type Polygon or MultiPolygon."""
    parsed = F.from_json(geometry, "type string, coordinates string")
    kind, text = parsed["type"], parsed["coordinates"]

    def rings(lists: Column) -> Column:
        return F.transform(lists, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))

    one = F.from_json(text, "array<array<array<double>>>")
    several = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    return F.when(kind == "Polygon", _whole(rings(one))).when(kind == "MultiPolygon", _whole(rings(several)))


def _polygons(ring: str) -> str:
    """SQL: the rings by polygon: one at even depth begins a polygon, the holes that follow belong to it."""
    return (
        f"aggregate(zip_with({ring}, {ring_depths(ring)}, (r, d) -> named_struct('r', r, 'd', d)), array(slice({ring}, 1, 0)), "
        "(acc, p) -> if(p.d % 2 = 0 or size(acc) = 1, "
        "concat(acc, array(array(p.r))), concat(slice(acc, 1, size(acc) - 1), array(concat(element_at(acc, -1), array(p.r))))), "
        "acc -> slice(acc, 2, size(acc)))"
    )


def ring_to_wkt(ring: str = "ring") -> Column:
    """WKT of a polygon column; numbers keep all their digits."""
    point = "concat(cast(p.x as string), ' ', cast(p.y as string))"
    closed = f"concat('(', array_join(transform(r, p -> {point}), ', '), ')')"
    polygon = f"concat('(', array_join(transform(g, r -> {closed}), ', '), ')')"
    return F.expr(
        f"if(size({ring}) = 0, 'MULTIPOLYGON EMPTY', concat('MULTIPOLYGON (', array_join(transform({_polygons(ring)}, g -> {polygon}), ', '), ')'))"
    )


def ring_to_geojson(ring: str = "ring") -> Column:
    """GeoJSON geometry of a polygon column; numbers keep all their digits."""
    nested = f"transform({_polygons(ring)}, g -> transform(g, r -> transform(r, p -> array(p.x, p.y))))"
    return F.expr(f"if({ring} is null, null, to_json(named_struct('type', 'MultiPolygon', 'coordinates', {nested})))")
