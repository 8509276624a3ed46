"""Polygons on the sphere: edges, area and density.

Edges are arcs of great circles, the shorter way between two corners, in containment as in area. A ring is a closed list of
longitude/latitude points. It may cross the date line and may go round a pole, which it then encloses if the
ring lies on that pole's side of the equator on the whole. Longitudes may be given beyond 180 degrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_010.0  # mean radius used for spherical areas


def wrapped(x: str) -> str:
    """SQL: a longitude between -180 (included) and 180 degrees; one that is there already keeps its bits."""
    return f"({x} - 360 * floor(({x} + 180) / 360))"


# SQL over one closed ring ``r``: its sides, with wrapped ends; ``turn`` is 1 or -1 if the shorter way leads over the date line.
RING_SIDES = (
    "transform(zip_with(slice(r, 1, greatest(size(r) - 1, 0)), slice(r, 2, greatest(size(r) - 1, 0)), "
    f"(a, b) -> named_struct('x1', {wrapped('a.x')}, 'y1', a.y, 'x2', {wrapped('b.x')}, 'y2', b.y)), "
    "e -> named_struct('x1', e.x1, 'y1', e.y1, 'x2', e.x2, 'y2', e.y2, "
    "'turn', if(e.x2 - e.x1 > 180, -1, if(e.x2 - e.x1 <= -180, 1, 0))))"
)

_STEP = "(e.x2 - e.x1 + 360 * e.turn)"

# SQL over one side ``e``: signed solid angle between the arc and the equator.
_EXCESS = (
    f"2 * atan2(tan(radians({_STEP}) / 2) * (tan(radians(e.y1) / 2) + tan(radians(e.y2) / 2)), "
    "1 + tan(radians(e.y1) / 2) * tan(radians(e.y2) / 2))"
)


def _edge(x1: str, y1: str, x2: str, y2: str) -> str:
    """SQL: an edge inside the map, with the tangents of its latitudes and the sine of its width."""
    return (
        f"named_struct('x1', {x1}, 'y1', {y1}, 'x2', {x2}, 'y2', {y2}, "
        f"'t1', tan(radians({y1})), 't2', tan(radians({y2})), 's', sin(radians({x2} - ({x1}))))"
    )


def _date_line_latitude(side: int) -> str:
    """SQL over a side ``e`` that leads over the date line: where it does."""
    rise = (
        f"tan(radians(e.y1)) * sin(radians(e.x2 + 360 * e.turn - {side})) + tan(radians(e.y2)) * sin(radians({side} - e.x1))"
    )
    arc = f"degrees(atan(({rise}) / sin(radians({_STEP}))))"
    return f"if(e.x1 = -180, e.y1, if(e.x2 = -180, e.y2, {arc}))"


# SQL over the sides ``s`` of a ring: its edges, cut in two at the date line.
_EDGES = (
    "flatten(transform(s, e -> case"
    f" when e.turn = 0 then array({_edge('e.x1', 'e.y1', 'e.x2', 'e.y2')})"
    f" when e.turn = 1 then transform(array({_date_line_latitude(180)}),"
    f" c -> array({_edge('e.x1', 'e.y1', '180d', 'c')}, {_edge('-180d', 'c', 'e.x2', 'e.y2')}))[0]"
    f" else transform(array({_date_line_latitude(-180)}),"
    f" c -> array({_edge('e.x1', 'e.y1', '-180d', 'c')}, {_edge('180d', 'c', 'e.x2', 'e.y2')}))[0] end))"
)

# SQL: per ring of a polygon its edges, the angle between it and the equator, and how far it turns round the earth.
_RINGS = (
    "filter(transform(transform({ring}, r -> " + RING_SIDES + "), s -> named_struct("
    f"'edges', {_EDGES}, 'angle', aggregate(s, 0d, (acc, e) -> acc + {_EXCESS}), "
    f"'turn', aggregate(s, 0d, (acc, e) -> acc + {_STEP}))), r -> size(r.edges) > 0)"
)
# SQL over such a ring: it goes round a pole, and which.
_NORTH, _SOUTH = "(abs({r}.turn) > 180 and {r}.angle * {r}.turn >= 0)", "(abs({r}.turn) > 180 and {r}.angle * {r}.turn < 0)"


def polygon_edges(ring: str) -> str:
    """SQL: struct of a polygon's ``edges``, whether it is ``flipped`` (encloses the north pole), and whether it reaches either pole."""
    north, south = (f"size(filter(rings, r -> {p.format(r='r')}))" for p in (_NORTH, _SOUTH))
    return (
        f"transform(array({_RINGS.format(ring=ring)}), rings -> named_struct('edges', flatten(transform(rings, r -> r.edges)), "
        f"'flipped', {north} % 2 = 1, 'north', {north} > 0, 'south', {south} > 0))[0]"
    )


def arc_height(x: str, edge: str = "e") -> str:
    """SQL: tangent of the latitude of an edge's arc at longitude ``x``, times the edge's ``s``."""
    return f"({edge}.t1 * sin(radians({edge}.x2 - {x})) + {edge}.t2 * sin(radians({x} - {edge}.x1)))"


def crossings(edges: str, flipped: str, x: str, y: str, t: str, touching: bool = True) -> str:
    """SQL: bit 0 is set if the polygon contains the point (x, y), ``t`` being the tangent of y; bit 1 if an edge goes through it.

    Bit 0 flips at every edge between the point and the north pole.
    """
    above = f"if(e.x2 > e.x1, {t} * e.s < {arc_height(x)}, {t} * e.s > {arc_height(x)})"
    crossed = f"case when (e.x1 > {x}) <> (e.x2 > {x}) then {above} else false end"
    touched = (
        f"case when {y} = e.y1 and ({x} = e.x1 or abs({y}) = 90) or {y} = e.y2 and {x} = e.x2 then 2"
        f" when {x} < least(e.x1, e.x2) or {x} > greatest(e.x1, e.x2) then 0"
        f" when e.x1 = e.x2 then if({y} between least(e.y1, e.y2) and greatest(e.y1, e.y2), 2, 0)"
        f" when {t} * e.s = {arc_height(x)} then 2 else 0 end"
    )
    return f"aggregate({edges}, int({flipped}), (acc, e) -> (acc ^ int({crossed})){f' | {touched}' if touching else ''})"


# SQL over the rings of a polygon: of ring ``d``, the ``i``-th, in how many of the others the middle of its first edge lies.
_MIDDLE = (
    "named_struct('x', (d.edges[0].x1 + d.edges[0].x2) / 2, "
    "'t', (d.edges[0].t1 + d.edges[0].t2) / 2 / cos(radians(d.edges[0].x2 - d.edges[0].x1) / 2))"
)
_DEPTH = (
    f"transform(array({_MIDDLE}), m -> size(filter(rings, (o, j) -> i <> j and "
    f"{crossings('o.edges', _NORTH.format(r='o'), 'm.x', '0', 'm.t', touching=False)} = 1)))[0]"
)


def ring_depths(ring: str) -> str:
    """SQL: per ring of a polygon, in how many of its other rings it lies."""
    return f"transform(array({_RINGS.format(ring=ring)}), rings -> transform(rings, (d, i) -> {_DEPTH}))[0]"


def ring_area_m2(ring: str = "ring") -> Column:
    """Area of a polygon column of rings of longitude/latitude points.

    A ring that lies in an odd number of the others is a hole and is subtracted, whatever its
    direction; all others, islands in holes included, add up. Where a ring lies is decided by
    the middle of its first edge, as containment is.
    """
    angle = "if(abs(d.turn) > 180, 2 * pi() - abs(d.angle), abs(d.angle))"
    signed = f"transform(rings, (d, i) -> {angle} * if({_DEPTH} % 2 = 0, 1d, -1d))"
    total = f"aggregate({signed}, 0d, (acc, v) -> acc + v)"
    angles = F.expr(f"transform(array({_RINGS.format(ring=ring)}), rings -> {total})[0]")
    return angles * F.lit(EARTH_RADIUS_M * EARTH_RADIUS_M)


def site_density(count: Column, area_m2: Column) -> Column:
    """Sites per square kilometre; missing where there is no count or no area."""
    return F.when(area_m2 > 0, count / (area_m2 / F.lit(1_000_000.0)))
