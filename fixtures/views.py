"""Survey-shaped views over the test tables (see FIXTURES.md).

One SQL text per view serves both engines: Spark fills the ``{table}`` placeholders with DataFrames,
the SQL check with table names.
"""

from __future__ import annotations

import re
from functools import cache, cached_property
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.plans.ingest import prepare_pathogen, prepare_species
from trapline.session import more_parts, own_folder
from trapline.sources.tables import laid_out, load_table
from trapline.survey import LAYOUT

# Columns read from each test table.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double",
}

# Five events share a spot, so the number of spots grows with the data.
_EVENT_POINT = """
 -17 + 24 * ((floor(event_id / cast(5 as double)) * 7919) % 10007) / cast(10007 as double) as lon,
 4 + 20 * ((floor(event_id / cast(5 as double)) * 104729) % 10009) / cast(10009 as double) as lat"""
_SUPPLIER_POINT = """
 -17 + 24 * ((l_suppkey * 7919) % 10007) / cast(10007 as double) as lon,
 4 + 20 * ((l_suppkey * 104729) % 10009) / cast(10009 as double) as lat"""

VIEWS = {
    "fx_studies": """
select o_orderkey as unique_id, concat('Study ', cast(o_orderkey as string)) as title,
 concat('CUSTOMER_', cast(o_custkey as string)) as country, o_orderpriority as journal_name,
 nullif(cast(year(o_orderdate) as bigint), 1995) as year_published,
 case when o_orderstatus = 'F' then 'Zoonoses risk' else 'Ecology' end as aim,
 o_orderstatus as detailed_aim_1, nullif(o_orderstatus, 'O') as detailed_aim_2,
 concat('<a href="', cast(o_orderkey as string), '">link</a>') as link,
 case o_orderpriority when '1-URGENT' then 'morphological, molecular' when '2-HIGH' then 'morphological'
  when '3-MEDIUM' then 'molecular' when '4-NOT SPECIFIED' then 'not_reported' end as speciation,
 case when o_totalprice < 100000 then 'Incomplete' when o_totalprice < 300000 then 'Complete'
  else 'None' end as trapping_effort
from {orders}""",
    "fx_spatial": f"""
select event_id as ord, nullif(user_id, 3) as unique_id,
 concat('NATION_', cast(user_id % 25 as string)) as country,{_EVENT_POINT},
 case when event_type in ('click', 'view') then 'Zoonoses risk' else 'Ecology' end as aim,
 concat('Month ', cast(month(ts) as string)) as trap_period,
 event_type as town_village, nullif(cast(floor(value) as bigint), 1) as trap_nights
from {{events}}""",
    "fx_species": f"""
select event_id as ord, user_id as unique_id, split_part(p_name, ' ', 1) as genus,
 p_name as classification,{_EVENT_POINT},
 case when event_type in ('click', 'purchase') then 'orange' else 'green' end as pa_colour,
 nullif(event_type, 'signup') as town_village, cast(floor(value) as bigint) % 7 as number,
 nullif(cast(floor(value) as bigint), 1) as trap_nights
from (select *, event_id % (select count(*) from {{part}}) as part_no from {{events}})
 join {{part}} on part_no = p_partkey""",
    "fx_rodent_summary": """
select split_part(p_name, ' ', 1) as genus, replace(p_name, ' ', '_') as classification,
 case l_linenumber when 1 then 'NA' when 2 then null when 3 then 'dry_savannah'
  when 4 then 'village_inside' else 'cropland' end as trap_habitat
from {lineitem} join {part} on l_partkey = p_partkey""",
    "fx_pathogen": f"""
select l_orderkey * 10 + l_linenumber as ord, l_orderkey as unique_id, n_name as country,
 concat('N', cast(n_nationkey as string)) as iso3c, replace(p_name, ' ', '_') as classification,
 p_brand as pathogen_clean, nullif(p_brand, 'Brand#7') as pathogen_tested,
 case p_type when 'STANDARD' then 'Bacteria' when 'PROMO' then 'Virus' when 'ECONOMY' then 'Parasite'
  when 'SMALL' then null else 'Other' end as pathogen_group,
 case when l_linenumber = 7 then 'pcr_other' when l_returnflag = 'A' then 'pcr_tested'
  when l_returnflag = 'R' then 'pcr_positive' end as assay,
 case when l_quantity = 1 and l_returnflag = 'R' and p_brand in ('Brand#3', 'Brand#12') then null
  else cast(l_quantity as bigint) end as number,
 cast(l_quantity as bigint) + l_linenumber as samples_tested,{_SUPPLIER_POINT},
 case when l_returnflag = 'R' then '#998ec3' else '#f1a340' end as pa_colour,
 nullif(n_name, 'NATION_4') as town_village, cast(year(l_shipdate) as bigint) as year_trapping,
 cast(month(l_shipdate) as bigint) as month
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{customer}} on o_custkey = c_custkey
 join {{nation}} on c_nationkey = n_nationkey join {{part}} on l_partkey = p_partkey""",
    "fx_level_0": """
select concat('N', cast(n_nationkey as string)) as gid_0, n_name as name_0
from {nation} join {region} on n_regionkey = r_regionkey where r_name <> 'MIDDLE EAST'""",
}

# One slanted pentagon per region on a grid over the survey area: corners in 480ths and 400ths of a
# grid cell.
CORNERS = ((13, 11), (431, 37), (457, 361), (221, 283), (29, 379))

# Grid cell of a nation (five to a row, in hundredths of a degree) and of a supplier (as many to a row
# as there are rows).
_NATION_X, _NATION_Y = "n_nationkey % 5 * 480", "cast(floor(n_nationkey / cast(5 as double)) as int) * 400"
_PLACED_SUPPLIERS = """(select s_suppkey, s_name, s_nationkey, side, s_suppkey % side as across,
 cast(floor(s_suppkey / cast(side as double)) as bigint) as down
 from (select *, (select cast(ceil(sqrt(count(*))) as bigint) from {supplier}) as side from {supplier}) a) b"""


def _nation_corner(number: int) -> tuple[str, str]:
    x, y = CORNERS[number % len(CORNERS)]
    return (
        f"-17 + ({_NATION_X} + {x}) / cast(100 as double)",
        f"4 + ({_NATION_Y} + {y}) / cast(100 as double)",
    )


def _supplier_corner(number: int) -> tuple[str, str]:
    x, y = CORNERS[number % len(CORNERS)]
    return (
        f"-17 + (across * 480 + {x}) / cast(20 * side as double)",
        f"4 + (down * 400 + {y}) / cast(20 * side as double)",
    )


def _ring_sql(corner, count: int = len(CORNERS)) -> str:
    """``ring`` column of the region outlines, in Spark SQL."""
    points = [corner(i) for i in range(count)] + [corner(0)]
    listed = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in points)
    return f"array(array({listed}))"


def _edges_sql(columns: str, source: str, corner, count: int = len(CORNERS)) -> str:
    """Outlines as one row per edge, in standard SQL."""
    parts = []
    for i in range(count):
        (x1, y1), (x2, y2) = corner(i), corner((i + 1) % count)
        parts.append(f"select {columns}, {i} as seq, {x1} as x1, {y1} as y1, {x2} as x2, {y2} as y2 from {source}")
    return " union all ".join(parts)


# Outlines with parts and holes: a square per nation with a smaller square in it, wound as the outer one
# or the other way, and an island in every third hole. Sides in hundredths of a degree.
_SQUARES = ((20, 20, 380, 1), (80, 80, 240, None), (140, 140, 60, 1))


def _square(x: int, y: int, side: int, forward: bool) -> list[tuple[str, str]]:
    corners = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return [
        (f"-17 + ({_NATION_X} + {a}) / cast(100 as double)", f"4 + ({_NATION_Y} + {b}) / cast(100 as double)")
        for a, b in (corners if forward else corners[::-1])
    ]


def _holed_ring_sql() -> str:
    def ring(points: list[tuple[str, str]]) -> str:
        return "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in points) + ")"

    outer, hole, island = _SQUARES
    hole_ring = f"if(n_nationkey % 2 = 0, {ring(_square(*hole[:3], True))}, {ring(_square(*hole[:3], False))})"
    whole = f"array({ring(_square(*outer[:3], True))}, {hole_ring}, {ring(_square(*island[:3], True))})"
    return f"if(n_nationkey % 3 = 0, {whole}, slice({whole}, 1, 2))"


def _holed_edges_sql() -> str:
    parts = []
    for number, (x, y, side, _) in enumerate(_SQUARES):
        points = _square(x, y, side, True)
        where = " where n_nationkey % 3 = 0" if number == 2 else ""
        parts += [
            f"select n_nationkey as region_id, n_name as name_2, {-1 if number == 1 else 1} as sign, {number} as part, "
            f"{x1} as x1, {y1} as y1, {x2} as x2, {y2} as y2 from nation{where}"
            for (x1, y1), (x2, y2) in zip(points, points[1:])
        ]
    return " union all ".join(parts)


# A band across the whole survey area per continent, four corners each.
def _wide_corner(number: int) -> tuple[str, str]:
    x, y = ((-1691, 411), (689, 437), (677, 771), (-1673, 757))[number % 4]
    return (
        f"({x} + r_regionkey * 3) / cast(100 as double)",
        f"({y} + r_regionkey * 397) / cast(100 as double)",
    )


# A cap per continent of twelve corners round a pole, north and south in turn; the southern ones are listed westwards.
def _polar_corner(number: int) -> tuple[str, str]:
    x = f"(r_regionkey * 7 + {30 * number} + 180) % 360 - 180"
    back = f"(r_regionkey * 7 + {360 - 30 * number} + 180) % 360 - 180"
    return (
        f"cast(case when r_regionkey % 2 = 0 then {x} else {back} end as double)",
        "cast((71 + 3 * r_regionkey) * case when r_regionkey % 2 = 0 then 1 else -1 end as double)",
    )


# Sites of the survey spread round both poles.
POLAR_POINT = "lon * 15 as lon, (66 + lat) * case when ord % 2 = 0 then 1 else -1 end as lat"

MOVED_DEGREES = 185


def moved(lon: Column) -> Column:
    """A longitude further east, between -180 and 180 degrees."""
    east = lon + MOVED_DEGREES
    return F.when(east > 180, east - 360).otherwise(east)


def moved_rings(regions: DataFrame) -> DataFrame:
    """Regions further east, as ``moved``."""
    point = lambda p: F.struct(moved(p["x"]).alias("x"), p["y"].alias("y"))
    return regions.withColumn("ring", F.transform("ring", lambda r: F.transform(r, point)))


_LEVEL_2 = "n_nationkey as region_id, concat('R', cast(n_nationkey % 20 as string)) as name_2"
_CONTINENT = "r_regionkey as region_id, r_name as name_2"
_DISTRICT = (
    "s_suppkey as region_id, s_name as name_2, concat('N', cast(s_nationkey as string)) as gid_0"
)


class Survey:
    """The fixture views of one data directory as DataFrames."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self._spark, self._directory = spark, directory
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    @cache
    def open(cls, spark: SparkSession, directory: str) -> Survey:
        """The tables of a directory, opened once per session; every query still reads them."""
        return cls(spark, directory)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = load_table(self._spark, self._directory, name, SOURCES[name])
        return self._tables[name]

    def _view(self, sql: str, dealt: dict[str, str] | None = None) -> DataFrame:
        """A view. For large tables those of ``dealt`` are dealt by the key they are joined on, and a shuffled join follows their number."""
        used = sorted(set(re.findall(r"\{(\w+)\}", sql)))
        tables = {t: self.table(t) for t in used}
        view = self._spark.sql(sql, **tables)
        parts = more_parts(view) if dealt else None
        return self._spark.sql(sql, **tables | {t: tables[t].repartition(parts, k) for t, k in dealt.items()}) if parts else view

    @cached_property
    def studies(self) -> DataFrame:
        return self._view(VIEWS["fx_studies"])

    @cached_property
    def spatial(self) -> DataFrame:
        return self._view(VIEWS["fx_spatial"])

    @cached_property
    def species(self) -> DataFrame:
        return prepare_species(self._view(VIEWS["fx_species"]))

    @cached_property
    def rodent_summary(self) -> DataFrame:
        return self._view(VIEWS["fx_rodent_summary"])

    @cached_property
    def raw_pathogen(self) -> DataFrame:
        return self._view(VIEWS["fx_pathogen"], {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"})

    @property
    def pathogen(self) -> DataFrame:
        """The prepared assays, cleaned and laid out once per session, as a survey is when it is taken in."""
        path = f"{own_folder(self._spark)}/survey-{sha256(self._directory.encode()).hexdigest()[:16]}/pathogen.parquet"
        done = self._spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(done):
            laid_out(prepare_pathogen(self.raw_pathogen), LAYOUT["pathogen"]).write.mode("overwrite").parquet(path)
        return self._spark.read.parquet(path)

    @cached_property
    def level_0(self) -> DataFrame:
        outlines = self._view(
            "select concat('N', cast(n_nationkey as string)) as __id, "
            f"{_ring_sql(_nation_corner)} as ring from {{nation}}"
        )
        named = self._view(VIEWS["fx_level_0"])
        return named.join(outlines, F.col("gid_0") == F.col("__id")).drop("__id")

    @cached_property
    def level_2(self) -> DataFrame:
        return self._view(f"select {_LEVEL_2}, {_ring_sql(_nation_corner)} as ring from {{nation}}")

    @cached_property
    def holed(self) -> DataFrame:
        """Regions with holes of either winding, and islands in some holes."""
        return self._view(f"select n_nationkey as region_id, n_name as name_2, {_holed_ring_sql()} as ring from {{nation}}")

    @cached_property
    def wide(self) -> DataFrame:
        """Regions with long east-west edges."""
        return self._view(f"select {_CONTINENT}, {_ring_sql(_wide_corner, 4)} as ring from {{region}}")

    @cached_property
    def polar(self) -> DataFrame:
        """Regions round the poles."""
        return self._view(f"select {_CONTINENT}, {_ring_sql(_polar_corner, 12)} as ring from {{region}}")

    @cached_property
    def whole(self) -> DataFrame:
        """One region that holds every site."""
        corners = ((-18.0, 3.0), (8.0, 3.0), (8.0, 25.0), (-18.0, 25.0), (-18.0, 3.0))
        points = ", ".join(f"named_struct('x', {x}d, 'y', {y}d)" for x, y in corners)
        return self._view(f"select r_name as region_id, array(array({points})) as ring from {{region}} where r_regionkey = 0")

    @cached_property
    def districts(self) -> DataFrame:
        """Regions whose number grows with the data: one per supplier, with its country code."""
        return self._view(
            f"select {_DISTRICT}, {_ring_sql(_supplier_corner)} as ring from {_PLACED_SUPPLIERS}"
        )


# --- the same views and rules for the SQL check -------------------------------------------------


def sentence(c: str) -> str:
    """Sentence case in standard SQL."""
    steps = [
        (r"[^\p{L}\p{N}]+", " "),
        (r"(\p{Ll})(\p{Lu})", r"\1 \2"),
        (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2"),
        (r"(\p{L})(\p{N})", r"\1 \2"),
        (r"(\p{N})(\p{L})", r"\1 \2"),
    ]
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    c = f"lower(trim({c}))"
    return f"(upper(substr({c}, 1, 1)) || substr({c}, 2))"


def total(c: str) -> str:
    """Sum that is missing as soon as one summand is."""
    return f"(case when count({c}) = count(*) then cast(sum({c}) as bigint) end)"


def with_views(sql: str) -> str:
    """Put the fixture views in front of a query."""
    plain = {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in VIEWS.items()}
    plain["fx_level_2_edges"] = _edges_sql(_LEVEL_2, "nation", _nation_corner)
    plain["fx_district_edges"] = _edges_sql(
        _DISTRICT, _PLACED_SUPPLIERS.replace("{supplier}", "supplier"), _supplier_corner
    )
    plain["fx_holed_edges"] = _holed_edges_sql()
    plain["fx_wide_edges"] = _edges_sql(_CONTINENT, "region", _wide_corner, 4)
    plain["fx_polar_edges"] = _edges_sql(_CONTINENT, "region", _polar_corner, 12)
    plain["px_pathogen"] = (
        f"select * replace ({sentence('classification')} as classification) from fx_pathogen"
    )
    plain["px_species"] = (
        "select * replace (case when trap_nights = 0 then 'Not reported' "
        "else cast(trap_nights as varchar) end as trap_nights) from fx_species"
    )
    needed, pending = [], [sql]
    while pending:
        text = pending.pop()
        for name, body in plain.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                needed.append(name)
                pending.append(body)
    views = ", ".join(f"{n} as ({plain[n]})" for n in plain if n in needed)
    body = sql.strip()
    if not views:
        return body
    if body.lower().startswith("with "):
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"
