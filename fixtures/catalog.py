"""Checked queries: each Spark query beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures.views import POLAR_POINT, Survey, moved, moved_rings, sentence, total, with_views
from trapline import constants as K
from trapline.functions.classes import class_of
from trapline.functions.missing import ascending, n_distinct_or_missing
from trapline.functions.sphere import EARTH_RADIUS_M, ring_area_m2
from trapline.functions.text import (
    assay_status,
    effort_label,
    popup_label,
    sentence_case,
    speciation_label,
)
from trapline.operators.choices import filter_groups, filter_in, filter_reported, filter_selected, value_list
from trapline.operators.clusters import cell_degrees
from trapline.operators.joins import left_join_na
from trapline.operators.order import (
    order_by_count,
    rank_by_frequency,
    rank_by_value,
    rows_at,
    with_row_id,
    with_running_total,
)
from trapline.operators.rollup import (
    assay_totals,
    count_by,
    distinct_by,
    first_row_by,
    host_pathogen,
    median_by,
    tested_by_country,
)
from trapline.operators.levels import levels_of, with_level_colour
from trapline.operators.spatial import (
    join_points_in_regions,
    region_studies_text,
    region_study_chunks,
    region_study_places,
    sites_by_region,
    studies_by_region,
)
from trapline.plans import associations, microbes, sites, species, studies
from trapline.session import new_folder
from trapline.sources.borders import load_borders, write_borders
from trapline.sources.layers import open_points, store_points
from trapline.sources.paging import PagedTable, open_pages, store_pages
from trapline.sources.rollups import append_rollup, compact_rollup, open_rollup, store_rollup
from trapline.sources.tables import load_regions, load_table, union_regions, with_lon_lat

Query = Callable[[SparkSession, str], DataFrame]

# Choices a user could make in the fixture data.
GENERA = ["Red", "Small"]
HOSTS = ["Small ring", "Red bolt", "Old gear"]
PATHOGENS = ["Brand#3"]
SPECIES = ["small ring", "red bolt"]
GROUPS = ["Virus"]
AIMS = ("Ecology", "Zoonoses risk")
COUNTRY_CODES = [f"N{i}" for i in range(17)]
STUDY_ROWS = [12, 3, 45, 7, 150, 99]
TABLE_ROWS = [1, 2, 3, 40, 41, 250, 600, 1500, 4000, 9000, 15000, 20000]
ZOOMS = (3, 5, 7)
VALUE_BREAKS = (0, 1, 5, 10, 50, 100, 250)

CATALOG: dict[str, tuple[Query, str | None]] = {}


def check(name: str, sql: str | None):
    """Register a query on the fixture views with its SQL."""

    def register(build: Callable[[Survey], DataFrame]):
        CATALOG[name] = (
            lambda spark, directory: build(Survey.open(spark, directory)),
            with_views(sql) if sql else None,
        )
        return build

    return register


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round computed doubles before they are compared."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# ---------------------------------------------------------------------------------- studies


def _stacked(key: str, source: str) -> str:
    return f"""
with c as (select {key}, aim, count(*) as number from {source} group by 1, 2),
 s as (select *, cast(sum(number) over (partition by {key} order by aim desc nulls first
  rows unbounded preceding) as bigint) as y_max from c)
select {key}, aim, number, y_max, y_max - number as y_min from s"""


@check(
    "studies_per_year",
    _stacked("year_published", "(select * from fx_studies where year_published is not null)"),
)
def _(s: Survey) -> DataFrame:
    return studies.studies_per_year(s.studies)


@check(
    "studies_per_country_year",
    """
with pairs as (select distinct unique_id, country from fx_spatial),
 dated as (select p.country, s.year_published from pairs p
  left join fx_studies s on p.unique_id is not distinct from s.unique_id),
 ranks as (select country, row_number() over (order by count(*), country desc) as level_rank
  from dated where country is not null group by country)
select d.country, d.year_published, count(*) as number, any_value(r.level_rank) as level_rank
from dated d left join ranks r on d.country is not distinct from r.country
where d.year_published is not null group by 1, 2""",
)
def _(s: Survey) -> DataFrame:
    return studies.studies_per_country_year(s.spatial, s.studies)


_SPECIATION = (
    f"case when speciation = '{K.BOTH_METHODS_RAW}' then '{K.BOTH_METHODS_LABEL}' "
    f"else {sentence('speciation')} end"
)


@check(
    "studies_per_speciation",
    _stacked("speciation", f"(select {_SPECIATION} as speciation, aim from fx_studies)"),
)
def _(s: Survey) -> DataFrame:
    return studies.studies_per_speciation(s.studies)


@check("studies_per_effort", _stacked("trapping_effort", "fx_studies"))
def _(s: Survey) -> DataFrame:
    return studies.studies_per_effort(s.studies)


_STUDY_COLUMNS = (
    "unique_id, title, country, journal_name, year_published, aim, detailed_aim_1, detailed_aim_2, link"
)


def _study_columns(s: Survey) -> DataFrame:
    return s.studies.select(*_STUDY_COLUMNS.split(", "))


@check(
    "study_table_page",
    f"select {_STUDY_COLUMNS} from fx_studies order by unique_id limit 10 offset 20",
)
def _(s: Survey) -> DataFrame:
    return studies.study_table(_study_columns(s), page=3)


@check(
    "short_study_table_page",
    """
select unique_id, year_published, aim, link from fx_studies
order by year_published desc nulls last, unique_id limit 15 offset 15""",
)
def _(s: Survey) -> DataFrame:
    return studies.short_study_table(
        _study_columns(s), page=2, order=[F.col("year_published").desc_nulls_last()]
    )


@check(
    "study_table_filtered_page",
    f"""
select {_STUDY_COLUMNS} from fx_studies
where contains(lower(aim), 'zoo') and year_published between 1996 and 1999
 and journal_name in ('1-URGENT', '5-LOW')
 and contains(lower(concat_ws(' ', {_STUDY_COLUMNS})), 'customer_1')
 and contains(lower(concat_ws(' ', {_STUDY_COLUMNS})), 'urgent')
order by country, unique_id limit 10 offset 10""",
)
def _(s: Survey) -> DataFrame:
    return studies.study_table(
        _study_columns(s), page=2, search="customer_1 URGENT", order=ascending("country"),
        column_filters={
            "aim": "zoo", "year_published": (1996, 1999), "journal_name": ["1-URGENT", "5-LOW"],
        },
    )


def _paged_studies(s: Survey) -> PagedTable:
    """The study table stored in the order of the years, in folders of 2,000 rows."""
    spark = s.studies.sparkSession
    folder = new_folder(spark)
    store_pages(_study_columns(s), folder, "unique_id", [F.col("year_published").desc_nulls_last()], 2_000)
    return open_pages(spark, folder, 2_000)


_PAGE_ORDER = "order by year_published desc nulls last, unique_id"


@check("stored_page_deep_in_the_table", f"select {_STUDY_COLUMNS} from fx_studies {_PAGE_ORDER} limit 10 offset 13995")
def _(s: Survey) -> DataFrame:
    return _paged_studies(s).page(offset=13_995, limit=10)


@check(
    "stored_page_of_a_search",
    f"""
select {_STUDY_COLUMNS} from fx_studies where contains(lower(aim), 'zoo') and year_published between 1993 and 1997
 and contains(lower(concat_ws(' ', {_STUDY_COLUMNS})), 'customer_1') and contains(lower(concat_ws(' ', {_STUDY_COLUMNS})), '7')
{_PAGE_ORDER} limit 15 offset 15""",
)
def _(s: Survey) -> DataFrame:
    return _paged_studies(s).page({"aim": "zoo", "year_published": (1993, 1997)}, "Customer_1 7", offset=15, limit=15)


@check(
    "stored_rows_of_a_search",
    f"select {_STUDY_COLUMNS} from fx_studies where contains(lower(concat_ws(' ', {_STUDY_COLUMNS})), 'customer_123')",
)
def _(s: Survey) -> DataFrame:
    return _paged_studies(s).matches(search="CUSTOMER_123").select(*_STUDY_COLUMNS.split(", "))


@check(
    "stored_rows_by_position",
    f"select * from (select {_STUDY_COLUMNS}, row_number() over ({_PAGE_ORDER}) as position from fx_studies) where position in (1, 2000, 2001, 9999)",
)
def _(s: Survey) -> DataFrame:
    return _paged_studies(s).at([1, 2_000, 2_001, 9_999, 0])


_BY_YEAR = """
with n as (select unique_id, row_number() over (order by year_published desc nulls last, unique_id nulls last) as position from fx_studies)"""


@check(
    "selected_studies_text_by_year",
    _BY_YEAR + f"""
select 'Selected studies:' || string_agg(cast(unique_id as varchar), ', ' order by spot) as selection
from n join (values {", ".join(f"({p}, {i})" for i, p in enumerate(STUDY_ROWS))}) as c(p, spot) on position = p""",
)
def _(s: Survey) -> DataFrame:
    return studies.selected_studies_text(s.studies, STUDY_ROWS, [F.col("year_published").desc_nulls_last()])


_CLICKED = ", ".join(f"({p}, {i})" for i, p in enumerate(STUDY_ROWS))


@check(
    "selected_studies_text",
    f"""
with n as (select unique_id, row_number() over (order by unique_id nulls last) as position from fx_studies)
select 'Selected studies:' || string_agg(cast(unique_id as varchar), ', ' order by spot) as selection
from n join (values {_CLICKED}) as c(p, spot) on position = p""",
)
def _(s: Survey) -> DataFrame:
    return studies.selected_studies_text(s.studies, STUDY_ROWS)


@check(
    "sites_with_study",
    """
select p.unique_id, p.country, s.aim, s.year_published
from (select distinct unique_id, country from fx_spatial) p
left join fx_studies s on p.unique_id is not distinct from s.unique_id""",
)
def _(s: Survey) -> DataFrame:
    pairs = distinct_by(s.spatial, ["unique_id", "country"])
    return left_join_na(pairs, s.studies.select("unique_id", "aim", "year_published"), "unique_id")


# ------------------------------------------------------------------------------------ sites

_BASE = """
select distinct lon, lat, 'black' as colour, 1 as radius, cast(null as varchar) as popup,
 'All studies' as layer from {}"""


@check("site_base_layer", _BASE.format("fx_spatial"))
def _(s: Survey) -> DataFrame:
    return sites.base_layer(s.spatial)


@check("assay_base_layer", _BASE.format("fx_pathogen"))
def _(s: Survey) -> DataFrame:
    return sites.base_layer(s.pathogen)


@check(
    "first_site_per_coordinate",
    """
select * exclude (rn) from (select *, row_number() over (partition by lon, lat order by ord) as rn
from fx_spatial) where rn = 1""",
)
def _(s: Survey) -> DataFrame:
    return sites.distinct_sites(s.spatial)


_ASSAY_ROW = (
    "unique_id, country, iso3c, classification, pathogen_clean, assay, number, samples_tested"
)


@check(
    "first_assay_per_coordinate",
    f"""
select ord, lon, lat, {_ASSAY_ROW} from (select *, row_number() over (partition by lon, lat
 order by ord, {', '.join(c + ' nulls first' for c in _ASSAY_ROW.split(', '))}) as rn
from px_pathogen) where rn = 1""",
)
def _(s: Survey) -> DataFrame:
    rows = s.pathogen.select("ord", "lon", "lat", *_ASSAY_ROW.split(", "))
    return first_row_by(rows, ["lon", "lat"], ["ord"])


@check(
    "selected_site_layer",
    f"""
with n as (select unique_id, row_number() over (order by unique_id nulls last) as position from fx_studies)
select lon, lat, case aim when 'Ecology' then '#FFA500' when 'Zoonoses risk' then '#A020F0' end as colour,
 6 as radius, 'Study ID: ' || coalesce(cast(unique_id as varchar), 'NA') || '<br>' || trap_period
 || '<br>Village/Region: ' || coalesce(town_village, 'NA') || '<br>Number of trap nights: '
 || coalesce(cast(trap_nights as varchar), 'NA') as popup, 'Selected studies' as layer
from fx_spatial where unique_id in
 (select unique_id from n where position in ({', '.join(map(str, STUDY_ROWS))}))""",
)
def _(s: Survey) -> DataFrame:
    return sites.selected_site_layer(s.spatial, s.studies, STUDY_ROWS, AIMS)


@check(
    "selected_site_layer_by_year",
    _BY_YEAR + f"""
select lon, lat, case aim when 'Ecology' then '#FFA500' when 'Zoonoses risk' then '#A020F0' end as colour,
 6 as radius, 'Study ID: ' || coalesce(cast(unique_id as varchar), 'NA') || '<br>' || trap_period
 || '<br>Village/Region: ' || coalesce(town_village, 'NA') || '<br>Number of trap nights: '
 || coalesce(cast(trap_nights as varchar), 'NA') as popup, 'Selected studies' as layer
from fx_spatial where unique_id in
 (select unique_id from n where position in ({', '.join(map(str, STUDY_ROWS))}))""",
)
def _(s: Survey) -> DataFrame:
    order = [F.col("year_published").desc_nulls_last()]
    return sites.selected_site_layer(s.spatial, s.studies, STUDY_ROWS, order=order)


_T1, _T2 = "tan(radians(y1) / 2)", "tan(radians(y2) / 2)"


def _unit(x: str, y: str) -> tuple[str, str, str]:
    x, y = f"radians({x})", f"radians({y})"
    return f"(cos({y}) * cos({x}))", f"(cos({y}) * sin({x}))", f"sin({y})"


def _normals(edges: str) -> str:
    """Edges with the normal of the plane through the earth's centre and both ends."""
    (a1, a2, a3), (b1, b2, b3) = _unit("x1", "y1"), _unit("x2", "y2")
    return f"""(select *, {a2} * {b3} - {a3} * {b2} as n1, {a3} * {b1} - {a1} * {b3} as n2, {a1} * {b2} - {a2} * {b1} as n3
 from {edges})"""


def _vectors(points: str) -> str:
    p1, p2, p3 = _unit("lon", "lat")
    return f"(select *, {p1} as p1, {p2} as p2, {p3} as p3 from {points})"


def _hits(edges: str) -> str:
    """Sites with an odd number of great-circle edges north of them."""
    return f"""
hits as (select p.ord, p.unique_id, p.lon, p.lat, e.region_id from {_vectors('fx_spatial')} p join {_normals(edges)} e
 on (e.x1 > p.lon) <> (e.x2 > p.lon) and (e.n1 * p.p1 + e.n2 * p.p2 + e.n3 * p.p3 < 0) = (e.x2 > e.x1)
 group by all having count(*) % 2 = 1)"""


def _areas(edges: str) -> str:
    return f"""
areas as (select region_id, name_2, abs(sum(2 * atan2(tan(radians(x2 - x1) / 2) * ({_T1} + {_T2}),
 1 + {_T1} * {_T2}))) * {EARTH_RADIUS_M} * {EARTH_RADIUS_M} as area_m2
 from {edges} group by 1, 2)"""


_HITS, _AREAS = _hits("fx_level_2_edges"), _areas("fx_level_2_edges")


def _per_region(group: str) -> str:
    return f"""
seen as (select g.{group}, h.unique_id, count(*) as n, min(h.ord) as first from hits h
  join areas g on h.region_id = g.region_id group by 1, 2),
 counts as (select {group}, cast(sum(n) as bigint) as n, count(*) as n_studies,
  count(unique_id) as n_known_studies from seen group by 1)"""


def _classes(c: str, breaks) -> str:
    parts, last = [], len(breaks) - 1
    for i in range(1, last + 1):
        upper = "<=" if i == last else "<"
        parts.append(f"when {c} >= {breaks[i - 1]} and {c} {upper} {breaks[i]} then {i}")
    return f"case {' '.join(parts)} end"


def _density(group: str, edges: str = "fx_level_2_edges", areas=_areas) -> str:
    return f"""
with {_hits(edges)}, {areas(edges)}, {_per_region(group)},
 dens as (select a.region_id, a.name_2, c.n, c.n_studies, c.n_known_studies, a.area_m2,
  c.n / (a.area_m2 / 1000000.0) as d from areas a left join counts c on a.{group} = c.{group})"""


def _density_rows(group: str, edges: str = "fx_level_2_edges", areas=_areas) -> str:
    return _density(group, edges, areas) + f"""
select region_id, name_2, n, n_studies, n_known_studies, round(area_m2, 0) as area_m2,
 round(d, 9) as sites_per_km2, {_classes('d', K.DENSITY_BREAKS)} as density_class from dens"""


def _study_texts(key: str) -> str:
    return f"""(select {key}, string_agg(coalesce(cast(unique_id as varchar), 'NA'), ', '
  order by first, unique_id nulls last) as studies from seen group by 1)"""


@check("site_density_by_region", _density_rows("region_id"))
def _(s: Survey) -> DataFrame:
    density = sites.site_density_by_region(s.level_2, s.spatial).drop("ring")
    return rounded(density, area_m2=0, sites_per_km2=9)


@check("site_density_by_name", _density_rows("name_2"))
def _(s: Survey) -> DataFrame:
    density = sites.site_density_by_region(s.level_2, s.spatial, group="name_2").drop("ring")
    return rounded(density, area_m2=0, sites_per_km2=9)


@check("site_density_shuffled_cells", _density_rows("region_id"))
def _(s: Survey) -> DataFrame:
    density = sites.site_density_by_region(s.level_2, s.spatial, broadcast_bytes=0).drop("ring")
    return rounded(density, area_m2=0, sites_per_km2=9)


@check(
    "density_layer",
    _density("region_id") + f"""
select region_id as region, round(d, 9) as value,
 case when d < 0.001 then '0.000 to 0.001' when d < 0.005 then '0.001 to 0.005'
  when d < 0.01 then '0.005 to 0.010' when d < 0.05 then '0.010 to 0.050'
  when d < 1 then '0.050 to 1.000' when d <= 6 then '1.000 to 6.000' end as class,
 name_2 || '<br>Site density: ' || printf('%.6f', d) || coalesce('<br>Studies trapping here: ' || studies, '') as label,
 'Trap density map' as layer from dens left join {_study_texts('region_id')} using (region_id) where n_known_studies > 0""",
)
def _(s: Survey) -> DataFrame:
    density = sites.site_density_by_region(s.level_2, s.spatial)
    seen = sites.studies_in_regions(s.level_2, s.spatial)
    texts = region_studies_text(seen, "region_id", "unique_id")
    return rounded(sites.density_layer(density, texts).drop("ring"), value=9)


@check("site_density_by_district", _density_rows("region_id", "fx_district_edges"))
def _(s: Survey) -> DataFrame:
    density = sites.site_density_by_region(s.districts, s.spatial).drop("ring", "gid_0")
    return rounded(density, area_m2=0, sites_per_km2=9)


@check(
    "border_layer",
    f"""
select gid_0 as region, cast(null as double) as value, cast(null as varchar) as class,
 'Country: ' || name_2 as label, 'Country borders' as layer, count(*) + 1 as outline_points
from fx_district_edges where gid_0 in ({quoted(COUNTRY_CODES)}) group by gid_0, name_2, region_id""",
)
def _(s: Survey) -> DataFrame:
    parts = s.districts.withColumnsRenamed({"name_2": "name_0"})
    borders = sites.border_layer(parts, COUNTRY_CODES)
    points = F.size(F.flatten("ring")).cast("bigint")
    return borders.withColumn("outline_points", points).drop("ring")


@check("points_in_regions", f"with {_HITS} select ord, lon, lat, region_id from hits")
def _(s: Survey) -> DataFrame:
    return join_points_in_regions(s.spatial.select("ord", "lon", "lat"), s.level_2, "region_id")


@check("sites_by_region", f"with {_HITS} select region_id, count(*) as n from hits group by 1")
def _(s: Survey) -> DataFrame:
    hits = join_points_in_regions(s.spatial.select("ord", "lon", "lat"), s.level_2, "region_id")
    return sites_by_region(hits, "region_id")


def _seen(s: Survey) -> DataFrame:
    return sites.studies_in_regions(s.level_2, s.spatial)


@check(
    "region_studies",
    f"with {_HITS} select region_id, unique_id, count(*) as n, min(ord) as first_ord from hits group by 1, 2",
)
def _(s: Survey) -> DataFrame:
    return _seen(s)


@check("studies_by_region", f"with {_HITS}, {_AREAS}, {_per_region('region_id')} select * from counts")
def _(s: Survey) -> DataFrame:
    return studies_by_region(_seen(s), "region_id", "unique_id")


@check(
    "region_studies_text",
    f"""
with {_HITS}, {_AREAS}, {_per_region('region_id')} select * from {_study_texts('region_id')}""",
)
def _(s: Survey) -> DataFrame:
    return region_studies_text(_seen(s), "region_id", "unique_id")


@check(
    "region_study_places",
    f"""
with {_HITS} select region_id, row_number() over (partition by region_id order by min(ord), unique_id nulls last) as place, unique_id
from hits group by region_id, unique_id""",
)
def _(s: Survey) -> DataFrame:
    return region_study_places(_seen(s), "region_id", "unique_id")


# One region with a study per site: thousands of studies at any scale.
_ALL_SITES = "select (select r_name from region where r_regionkey = 0) as region_id, ord from fx_spatial"


@check(
    "studies_of_a_crowded_region",
    f"select region_id, count(*) as n, count(*) as n_studies, count(*) as n_known_studies from ({_ALL_SITES}) group by 1",
)
def _(s: Survey) -> DataFrame:
    crowded = s.spatial.withColumn("unique_id", F.col("ord"))
    return studies_by_region(sites.studies_in_regions(s.whole, crowded), "region_id", "unique_id")


@check(
    "studies_text_of_a_crowded_region",
    f"""
select region_id, cast(floor((place - 1) / 1000) as bigint) as chunk, string_agg(cast(ord as varchar), ', ' order by ord) as studies
from (select *, row_number() over (order by ord) as place from ({_ALL_SITES})) group by 1, 2""",
)
def _(s: Survey) -> DataFrame:
    crowded = s.spatial.withColumn("unique_id", F.col("ord"))
    places = region_study_places(sites.studies_in_regions(s.whole, crowded), "region_id", "unique_id")
    return region_study_chunks(places, "region_id", "unique_id")


def _holed_areas(edges: str) -> str:
    ring = f"""abs(sum(2 * atan2(tan(radians(x2 - x1) / 2) * ({_T1} + {_T2}), 1 + {_T1} * {_T2})))"""
    return f"""
areas as (select region_id, name_2, sum(a) * {EARTH_RADIUS_M} * {EARTH_RADIUS_M} as area_m2 from (
 select region_id, name_2, sign * {ring} as a from {edges} group by region_id, name_2, part, sign) group by 1, 2)"""


@check("points_in_holed_regions", f"with {_hits('fx_holed_edges')} select ord, lon, lat, region_id from hits")
def _(s: Survey) -> DataFrame:
    return join_points_in_regions(s.spatial.select("ord", "lon", "lat"), s.holed, "region_id")


@check("site_density_of_holed_regions", _density_rows("region_id", "fx_holed_edges", _holed_areas))
def _(s: Survey) -> DataFrame:
    density = sites.site_density_by_region(s.holed, s.spatial).drop("ring")
    return rounded(density, area_m2=0, sites_per_km2=9)


# Regions as wide as the survey area: their edges run well off the straight lines of the map.
@check("points_in_wide_regions", f"with {_hits('fx_wide_edges')} select ord, lon, lat, region_id from hits")
def _(s: Survey) -> DataFrame:
    return join_points_in_regions(s.spatial.select("ord", "lon", "lat"), s.wide, "region_id")


@check("site_density_of_wide_regions", _density_rows("region_id", "fx_wide_edges"))
def _(s: Survey) -> DataFrame:
    density = sites.site_density_by_region(s.wide, s.spatial).drop("ring")
    return rounded(density, area_m2=0, sites_per_km2=9)


# Districts and sites moved east until the date line runs through them: counts and areas stay.
@check("site_density_across_the_date_line", _density_rows("region_id", "fx_district_edges"))
def _(s: Survey) -> DataFrame:
    density = sites.site_density_by_region(moved_rings(s.districts), s.spatial.withColumn("lon", moved(F.col("lon")))).drop("ring", "gid_0")
    return rounded(density, area_m2=0, sites_per_km2=9)


_POLAR_SITES = f"(select ord, unique_id, {POLAR_POINT} from fx_spatial)"
_HALF = "tan(radians(90 - abs(lat)) / 2)"


# Caps round both poles. A site is in a cap if it is on the pole's side of every edge; a cap is made of triangles that meet in its pole.
@check(
    "site_density_around_the_poles",
    f"""
with out as (select p.ord, e.region_id from {_vectors(_POLAR_SITES)} p join {_normals('fx_polar_edges')} e
  on e.n1 * p.p1 + e.n2 * p.p2 + e.n3 * p.p3 < 0),
 hits as (select p.ord, p.unique_id, r.region_id from {_POLAR_SITES} p cross join (select distinct region_id from fx_polar_edges) r
  where not exists (select 1 from out o where o.ord = p.ord and o.region_id = r.region_id)),
 areas as (select region_id, name_2, sum(2 * atan2({_HALF} * {_HALF} * sin(radians(30)), 1 + {_HALF} * {_HALF} * cos(radians(30))))
   * {EARTH_RADIUS_M} * {EARTH_RADIUS_M} as area_m2 from (select region_id, name_2, y1 as lat from fx_polar_edges) group by 1, 2),
 {_per_region('region_id')},
 dens as (select a.*, c.n, c.n_studies, c.n_known_studies, c.n / (a.area_m2 / 1000000.0) as d from areas a left join counts c using (region_id))
select region_id, name_2, n, n_studies, n_known_studies, round(area_m2, 0) as area_m2, round(d, 9) as sites_per_km2,
 {_classes('d', K.DENSITY_BREAKS)} as density_class from dens""",
)
def _(s: Survey) -> DataFrame:
    placed = s.spatial.drop("lon", "lat").join(s.spatial.selectExpr("ord", *POLAR_POINT.split(", ")), "ord")
    return rounded(sites.site_density_by_region(s.polar, placed).drop("ring"), area_m2=0, sites_per_km2=9)


@check(
    "points_in_districts",
    f"with {_hits('fx_district_edges')} select ord, lon, lat, region_id from hits",
)
def _(s: Survey) -> DataFrame:
    return join_points_in_regions(s.spatial.select("ord", "lon", "lat"), s.districts, "region_id")


@check(
    "region_areas",
    f"with {_areas('fx_district_edges')} select region_id, round(area_m2, 0) as area_m2 from areas",
)
def _(s: Survey) -> DataFrame:
    return s.districts.select("region_id", F.round(ring_area_m2("ring"), 0).alias("area_m2"))


@check(
    "regions_stacked",
    """
select region_id, name_2, gid_0, count(*) + 1 as outline_points from fx_district_edges
group by 1, 2, 3""",
)
def _(s: Survey) -> DataFrame:
    # One frame per remainder of the region id, as a survey has one per country.
    frames = [s.districts.filter(F.col("region_id") % 5 == part) for part in range(5)]
    points = F.size(F.flatten("ring")).cast("bigint").alias("outline_points")
    return union_regions(frames).select("region_id", "name_2", "gid_0", points)


def _stored(s: Survey, df: DataFrame) -> str:
    """Folder with ``df`` as a single table in the cluster's shared folder."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(f"{folder}/level_2_sites.parquet")
    return folder


@check(
    "regions_loaded",
    "select cast(region_id as varchar) as region_id, name_2, count(*) + 1 as outline_points from fx_district_edges group by 1, 2",
)
def _(s: Survey) -> DataFrame:
    folder = new_folder(s.districts.sparkSession)
    s.districts.withColumn("country", F.col("gid_0")).write.partitionBy("country").parquet(folder)
    points = F.size(F.flatten("ring")).cast("bigint").alias("outline_points")
    return load_regions(s.districts.sparkSession, folder).select("region_id", "name_2", points)


# Outlines written as border files and read again, in every form.
_OUTLINE_POINTS = """
with p as (select region_id, name_2, gid_0, seq, x1 as x, y1 as y from fx_district_edges
 union all select region_id, name_2, gid_0, 5, x1, y1 from fx_district_edges where seq = 0)
select cast(region_id as varchar) as region_id, name_2, gid_0, seq, x, y from p"""


def _through_files(s: Survey, regions: DataFrame, properties: list[str], form: str) -> DataFrame:
    spark = regions.sparkSession
    folder = new_folder(spark)
    write_borders(regions, folder, properties, form)
    return load_borders(spark, folder, {p: p for p in properties}, form)


def _outline_points(borders: DataFrame) -> DataFrame:
    return borders.select("region_id", "name_2", "gid_0", F.posexplode(F.flatten("ring")).alias("seq", "p")).select(
        "region_id", "name_2", "gid_0", "seq", "p.x", "p.y"
    )


@check("borders_from_geojson", _OUTLINE_POINTS)
def _(s: Survey) -> DataFrame:
    return _outline_points(_through_files(s, s.districts, ["region_id", "name_2", "gid_0"], "geojson"))


@check("borders_from_geojson_lines", _OUTLINE_POINTS)
def _(s: Survey) -> DataFrame:
    return _outline_points(_through_files(s, s.districts, ["region_id", "name_2", "gid_0"], "geojsonl"))


@check("borders_from_wkt", _OUTLINE_POINTS)
def _(s: Survey) -> DataFrame:
    return _outline_points(_through_files(s, s.districts, ["region_id", "name_2", "gid_0"], "wkt"))


@check(
    "site_density_from_border_files",
    f"select * replace (cast(region_id as varchar) as region_id) from ({_density_rows('region_id', 'fx_holed_edges', _holed_areas)})",
)
def _(s: Survey) -> DataFrame:
    borders = _through_files(s, s.holed, ["region_id", "name_2"], "geojsonl")
    return rounded(sites.site_density_by_region(borders, s.spatial).drop("ring"), area_m2=0, sites_per_km2=9)


# The sites stored without ``ord``, in several files that follow the order they were recorded in.
@check(
    "first_site_by_file_order",
    """
select ord, cast(unique_id as varchar) as unique_id, lon, lat from (select * replace (row_number() over (order by ord) as ord),
 row_number() over (partition by lon, lat order by ord) as rn from fx_spatial) where rn = 1""",
)
def _(s: Survey) -> DataFrame:
    folder = new_folder(s.spatial.sparkSession)
    s.spatial.orderBy("ord").drop("ord").write.option("maxRecordsPerFile", 2_000).parquet(f"{folder}/spatial.parquet")
    return sites.distinct_sites(load_table(s.spatial.sparkSession, folder, "spatial")).select("ord", "unique_id", "lon", "lat")


@check(
    "density_layer_from_stored_table",
    _density("region_id") + """
select cast(region_id as varchar) as region, round(d, 9) as value, name_2 || '<br>Site density: ' || printf('%.6f', d) as label
from dens where n_known_studies > 0""",
)
def _(s: Survey) -> DataFrame:
    folder = _stored(s, sites.site_density_by_region(s.level_2, s.spatial))
    stored = load_table(s.level_2.sparkSession, folder, "level_2_sites")
    return rounded(sites.density_layer(stored).select("region", "value", "label"), value=9)


@check("sites_from_wkt", "select ord, lon, lat from fx_spatial")
def _(s: Survey) -> DataFrame:
    text = F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    return with_lon_lat(s.spatial.select("ord", text.alias("geometry")))


@check(
    "aim_colours",
    "select ord, aim, case aim when 'Ecology' then '#FFA500' else '#A020F0' end as colour from fx_spatial",
)
def _(s: Survey) -> DataFrame:
    rows = s.spatial.select("ord", "aim")
    return with_level_colour(rows, "aim", levels_of(rows, "aim"), K.AIM_PALETTE)


@check(
    "village_colours",
    """
select ord, town_village, case (dense_rank() over (order by town_village) - 1) % 2 when 0 then '#FFA500' else '#A020F0' end as colour
from fx_spatial""",
)
def _(s: Survey) -> DataFrame:
    rows = s.spatial.select("ord", "town_village")
    return with_level_colour(rows, "town_village", levels_of(rows, "town_village"), K.AIM_PALETTE)


@check("value_classes", f"select event_id, {_classes('value', VALUE_BREAKS)} as class from events")
def _(s: Survey) -> DataFrame:
    return s.table("events").select("event_id", class_of(F.col("value"), VALUE_BREAKS).alias("class"))


# ---------------------------------------------------------------------------------- species


def _choices(counts: str, column: str, order: str, label: str | None = "All") -> str:
    listed = f"select row_number() over (order by {order}) as position, cast({column} as varchar) as choice from ({counts})"
    return listed if label is None else f"select 0 as position, '{label}' as choice union all {listed}"


@check(
    "genus_choices",
    _choices(f"select distinct {sentence('genus')} as genus from px_species", "genus", "genus nulls last"),
)
def _(s: Survey) -> DataFrame:
    return species.genus_choices(s.species)


_MOST = "number desc, classification nulls last"


@check(
    "species_choices",
    _choices(
        "select classification, count(*) as number from px_species group by 1",
        "classification", _MOST, "None selected",
    ),
)
def _(s: Survey) -> DataFrame:
    return species.species_choices(s.species, sentinel=K.NONE_SELECTED)


@check(
    "species_choices_by_genus",
    _choices(
        f"select classification, count(*) as number from px_species where {sentence('genus')} in ({quoted(GENERA)}) group by 1",
        "classification", _MOST,
    ),
)
def _(s: Survey) -> DataFrame:
    return species.species_choices(s.species, GENERA)


@check(
    "species_layer",
    f"""
select lon, lat, pa_colour as colour, 3 as radius, 'Study ID: ' || cast(unique_id as varchar)
 || '<br>Number of trapped individuals: ' || coalesce(cast(number as varchar), 'NA')
 || '<br>Village/Region: ' || coalesce(town_village, 'NA') || '<br>Number of trap nights: '
 || coalesce(trap_nights, 'NA') as popup, 'Selected species' as layer
from px_species where classification in ({quoted(SPECIES)})""",
)
def _(s: Survey) -> DataFrame:
    return species.species_layer(s.species, SPECIES)


def _habitats(where: str) -> str:
    return f"""
with c as (select {sentence('classification')} as classification, {sentence('trap_habitat')} as trap_habitat,
  count(*) as number from fx_rodent_summary where trap_habitat <> 'NA' and {where} group by 1, 2),
 r as (select classification, row_number() over (order by sum(number), classification desc) as level_rank
  from c where classification is not null group by 1)
select c.classification, c.trap_habitat, c.number, r.level_rank from c
left join r on c.classification is not distinct from r.classification"""


@check("habitat_counts", _habitats("true"))
def _(s: Survey) -> DataFrame:
    return species.individuals_per_habitat(s.rodent_summary)


@check(
    "habitat_counts_by_genus",
    _habitats(
        f"classification in (select classification from fx_rodent_summary where {sentence('genus')} in ({quoted(GENERA)}))"
    ),
)
def _(s: Survey) -> DataFrame:
    return species.individuals_per_habitat(s.rodent_summary, GENERA)


@check(
    "reported_habitats",
    "select trap_habitat, count(*) as number from fx_rodent_summary where trap_habitat <> 'NA' group by 1",
)
def _(s: Survey) -> DataFrame:
    return count_by(filter_reported(s.rodent_summary, "trap_habitat"), "trap_habitat")


@check(
    "species_by_frequency",
    """
select classification, row_number() over (order by count(*) desc, classification) as level_rank
from px_species where classification is not null group by 1""",
)
def _(s: Survey) -> DataFrame:
    return rank_by_frequency(count_by(s.species, "classification"), "classification")


@check(
    "species_by_frequency_reversed",
    """
with r as (select classification, row_number() over (order by count(*) desc, classification) as level_rank
 from px_species where classification is not null group by 1)
select classification, (select count(*) from r) + 1 - level_rank as level_rank from r""",
)
def _(s: Survey) -> DataFrame:
    return rank_by_frequency(count_by(s.species, "classification"), "classification", reverse=True)


@check(
    "effort_labels",
    """
select case when trap_nights = 0 then 'Not reported' else cast(trap_nights as varchar) end as effort,
 count(*) as number from fx_spatial group by 1""",
)
def _(s: Survey) -> DataFrame:
    return count_by(s.spatial.select(effort_label(F.col("trap_nights")).alias("effort")), "effort")


@check("species_names", f"select distinct {sentence('classification')} as name from fx_rodent_summary")
def _(s: Survey) -> DataFrame:
    return distinct_by(s.rodent_summary, ["classification"]).select(
        sentence_case(F.col("classification")).alias("name")
    ).distinct()


@check("speciation_labels", f"select {_SPECIATION} as speciation, count(*) as number from fx_studies group by 1")
def _(s: Survey) -> DataFrame:
    return count_by(s.studies.select(speciation_label(F.col("speciation")).alias("speciation")), "speciation")


# --------------------------------------------------------------------------- microorganisms


@check(
    "group_choices",
    _choices("select distinct pathogen_group from fx_pathogen", "pathogen_group", "pathogen_group nulls last"),
)
def _(s: Survey) -> DataFrame:
    return microbes.group_choices(s.pathogen)


# The list as a user interface holds it, taken up by a choice again.
@check("rows_of_listed_groups", "select pathogen_group, count(*) as number from fx_pathogen group by 1")
def _(s: Survey) -> DataFrame:
    groups = value_list(microbes.group_choices(s.pathogen).filter("position > 0"), "choice")
    return count_by(filter_in(s.pathogen, "pathogen_group", groups), "pathogen_group")


_MOST_MICROBES = "number desc, pathogen_clean nulls last"


@check(
    "microbe_choices",
    _choices(
        "select pathogen_clean, count(*) as number from fx_pathogen group by 1", "pathogen_clean", _MOST_MICROBES
    ),
)
def _(s: Survey) -> DataFrame:
    return microbes.microbe_choices(s.pathogen)


@check(
    "microbe_choices_by_group",
    _choices(
        f"select pathogen_clean, count(*) as number from fx_pathogen where pathogen_group in ({quoted(GROUPS)}) group by 1",
        "pathogen_clean", _MOST_MICROBES,
    ),
)
def _(s: Survey) -> DataFrame:
    return microbes.microbe_choices(s.pathogen, GROUPS)


_STATUS = (
    "case when contains(assay, 'tested') then 'Assayed' when contains(assay, 'positive') "
    "then 'Number positive' else 'Other' end"
)


def _assays(groups) -> str:
    return f"""
with t as (select {sentence('pathogen_tested')} as pathogen_tested, {_STATUS} as test_positive,
  {total('number')} as number from fx_pathogen where pathogen_group in ({quoted(groups)}) group by 1, 2),
 r as (select pathogen_tested, row_number() over (order by median(number) nulls last, pathogen_tested) as level_rank
  from t where pathogen_tested is not null group by 1)
select t.pathogen_tested, t.test_positive, t.number, r.level_rank, round(ln(1 + t.number), 9) as log_number
from t left join r on t.pathogen_tested is not distinct from r.pathogen_tested"""


@check("assays_per_microbe", _assays(K.DEFAULT_GROUPS))
def _(s: Survey) -> DataFrame:
    return rounded(microbes.assays_per_microbe(s.pathogen, [K.ALL]), log_number=9)


@check("assays_per_microbe_by_group", _assays(GROUPS))
def _(s: Survey) -> DataFrame:
    return rounded(microbes.assays_per_microbe(s.pathogen, GROUPS), log_number=9)


@check("assay_status_counts", f"select {_STATUS} as status, count(*) as number from fx_pathogen group by 1")
def _(s: Survey) -> DataFrame:
    return count_by(s.pathogen.select(assay_status(F.col("assay")).alias("status")), "status")


@check(
    "assay_totals",
    f"select pathogen_tested, {_STATUS} as status, {total('number')} as number from fx_pathogen group by 1, 2",
)
def _(s: Survey) -> DataFrame:
    rows = s.pathogen.withColumn("status", assay_status(F.col("assay")))
    return assay_totals(rows, "pathogen_tested", "status")


_DETECTED = "not coalesce(contains(assay, 'tested'), false)"


def _detection_layer(where: str) -> str:
    def text(c: str) -> str:
        return f"coalesce(cast({c} as varchar), 'NA')"

    return f"""
select lon, lat, pa_colour as colour, 6 as radius, 'Study ID: ' || {text('unique_id')} || '<br>Rodent species: '
 || {text('classification')} || '<br>Microorganism tested: ' || {text('pathogen_clean')}
 || '<br>Number of samples tested: ' || {text('samples_tested')} || '<br>Number of positive samples: '
 || {text('number')} || '<br>Village/Region: ' || {text('town_village')}
 || '<br>Year/month of rodent sampling: ' || {text('year_trapping')} || '  -  ' || {text('month')} as popup,
 'Selected species' as layer from px_pathogen where {_DETECTED} and {where}"""


@check("detection_layer", _detection_layer("true"))
def _(s: Survey) -> DataFrame:
    return microbes.detection_layer(s.pathogen, [K.ALL])


@check("detection_layer_by_microbe", _detection_layer(f"pathogen_clean in ({quoted(PATHOGENS)})"))
def _(s: Survey) -> DataFrame:
    return microbes.detection_layer(s.pathogen, PATHOGENS)


@check("detection_layer_in_a_view", f"select * from ({_detection_layer('true')}) where lon between -5.5 and 2.25 and lat between 6 and 11.5")
def _(s: Survey) -> DataFrame:
    folder = new_folder(s.raw_pathogen.sparkSession)
    store_points(microbes.detection_layer(s.pathogen, [K.ALL]), folder, 2_000)
    return open_points(s.raw_pathogen.sparkSession, folder).in_box(-5.5, 6, 2.25, 11.5)


_CLUSTERS = " union all ".join(
    f"select {z} as zoom, cast(floor(lon / {cell_degrees(z)}) as bigint) as cx, "
    f"cast(floor(lat / {cell_degrees(z)}) as bigint) as cy, lon, lat from fx_pathogen where {_DETECTED}"
    for z in ZOOMS
)


@check(
    "detection_clusters",
    f"""
select zoom, cx, cy, count(*) as number, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat
from ({_CLUSTERS}) group by 1, 2, 3""",
)
def _(s: Survey) -> DataFrame:
    return rounded(microbes.detection_clusters(s.pathogen, ZOOMS), lon=6, lat=6)


# Going through markers one by one is no SQL; tests compare with a plain loop.
@check("detection_markers", None)
def _(s: Survey) -> DataFrame:
    return rounded(microbes.detection_markers(s.pathogen, ZOOMS), mean_lon=6, mean_lat=6)


@check(
    "median_samples_per_microbe",
    "select pathogen_tested, median(samples_tested) as median from fx_pathogen group by 1",
)
def _(s: Survey) -> DataFrame:
    return median_by(s.pathogen, "pathogen_tested", "samples_tested")


@check(
    "microbes_by_median",
    """
select pathogen_tested, row_number() over (order by median(number) nulls last, pathogen_tested) as level_rank
from fx_pathogen where pathogen_tested is not null group by 1""",
)
def _(s: Survey) -> DataFrame:
    return rank_by_value(median_by(s.pathogen, "pathogen_tested", "number"), "pathogen_tested", "median")


@check(
    "groups_by_default",
    f"select pathogen_group, count(*) as number from fx_pathogen where pathogen_group in ({quoted(K.DEFAULT_GROUPS)}) group by 1",
)
def _(s: Survey) -> DataFrame:
    return count_by(filter_groups(s.pathogen, "pathogen_group", []), "pathogen_group")


@check(
    "microbes_by_count",
    "select pathogen_clean, count(*) as number from fx_pathogen group by 1 order by number desc, pathogen_clean",
)
def _(s: Survey) -> DataFrame:
    return order_by_count(count_by(s.pathogen, "pathogen_clean"), "pathogen_clean")


@check("no_species_selected", f"select ord, lon, lat from px_species where classification in ('{K.ALL}')")
def _(s: Survey) -> DataFrame:
    return filter_selected(s.species, "classification", [K.ALL]).select("ord", "lon", "lat")


# ------------------------------------------------------------------------------ associations

_KEYS = "country, iso3c, classification, pathogen_clean"


def _rollup(where: str = "true") -> str:
    return f"""
t as (select {_KEYS}, count(distinct unique_id) + max(case when unique_id is null then 1 else 0 end) as number_of_studies,
  {total('number')} as number_positive, {total('samples_tested')} as number_tested
 from px_pathogen where {_DETECTED} and {where} group by all),
 n as (select row_number() over (order by country nulls last, iso3c nulls last, classification nulls last,
  pathogen_clean nulls last) as id, * from t)"""


def _table(where: str = "true") -> str:
    return f"with {_rollup(where)} select * from n"


_BY_HOST = f"classification in ({quoted(HOSTS)})"
_BY_PATHOGEN = f"pathogen_clean in ({quoted(PATHOGENS)})"


@check("host_pathogen_table", _table())
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_table(s.pathogen)


@check("host_pathogen_table_by_host", _table(_BY_HOST))
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_table(s.pathogen, HOSTS, [K.ALL])


@check("host_pathogen_table_by_pathogen", _table(_BY_PATHOGEN))
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_table(s.pathogen, [K.ALL], PATHOGENS)


@check("host_pathogen_table_by_both", _table(f"{_BY_HOST} and {_BY_PATHOGEN}"))
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_table(s.pathogen, HOSTS, PATHOGENS)


@check("host_pathogen_table_from_raw_names", _table(_BY_HOST))
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_table(s.raw_pathogen, HOSTS, [K.ALL], associations.RAW)


def _stored_rollup(s: Survey, compact: bool = False) -> DataFrame:
    """The rollup of two thirds of the assays, joined by that of the rest, which holds the same studies."""
    spark = s.raw_pathogen.sparkSession
    folder = new_folder(spark)
    store_rollup(associations.clean_study_rollup(s.raw_pathogen.filter("ord % 3 <> 0")), folder)
    append_rollup(associations.clean_study_rollup(s.raw_pathogen.filter("ord % 3 = 0")), folder)
    if compact:
        compact_rollup(spark, folder)
    return open_rollup(spark, folder)


@check("host_pathogen_table_from_rollup", _table())
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_table(_stored_rollup(s), form=associations.ROLLUP)


@check("host_pathogen_table_from_rollup_by_both", _table(f"{_BY_HOST} and {_BY_PATHOGEN}"))
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_table(_stored_rollup(s, compact=True), HOSTS, PATHOGENS, associations.ROLLUP)


@check(
    "host_pathogen_page",
    f"""
with {_rollup()} select * from t where contains(lower(classification), 'ring') and number_of_studies >= 2
 and contains(lower(concat_ws(' ', {_KEYS}, number_of_studies, number_positive, number_tested)), 'brand#1')
order by number_tested desc nulls last, {', '.join(c + ' nulls last' for c in _KEYS.split(', '))} limit 10 offset 10""",
)
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_page(
        s.pathogen, page=2, order=[F.col("number_tested").desc_nulls_last()], search="brand#1",
        column_filters={"classification": "ring", "number_of_studies": (2, None)},
    )


@check("host_pathogen_table_no_host", _table())
def _(s: Survey) -> DataFrame:
    return associations.host_pathogen_table(s.pathogen, [], PATHOGENS)


_SELECTED = f"select * from n where id in ({', '.join(map(str, TABLE_ROWS))})"


_TESTED = f"""
with {_rollup()}, c as (select country, iso3c, {total('number_tested')} as number_tested
 from ({_SELECTED}) group by 1, 2)
select c.country, c.iso3c, c.number_tested, b.name_0, case when b.gid_0 is null then null else 6 end as outline_points
from c left join fx_level_0 b on c.iso3c = b.gid_0"""


def _outlined(tested: DataFrame) -> DataFrame:
    points = F.when(F.col("ring").isNotNull(), F.size(F.flatten("ring")))
    return tested.withColumn("outline_points", points).drop("ring")


@check("tested_per_country", _TESTED)
def _(s: Survey) -> DataFrame:
    return _outlined(associations.tested_per_country(s.pathogen, s.level_0, TABLE_ROWS))


@check("tested_per_country_from_rollup", _TESTED)
def _(s: Survey) -> DataFrame:
    return _outlined(associations.tested_per_country(_stored_rollup(s), s.level_0, TABLE_ROWS, form=associations.ROLLUP))


@check("host_pathogen_rollup", f"with {_rollup()} select * from t")
def _(s: Survey) -> DataFrame:
    return host_pathogen(s.pathogen)


@check("host_pathogen_rows", f"with {_rollup()} {_SELECTED}")
def _(s: Survey) -> DataFrame:
    table = host_pathogen(s.pathogen)
    return rows_at(table, ascending(*associations.TABLE_KEYS), TABLE_ROWS)


@check(
    "tested_by_country",
    f"with {_rollup()} select country, iso3c, {total('number_tested')} as number_tested from t group by 1, 2",
)
def _(s: Survey) -> DataFrame:
    return tested_by_country(host_pathogen(s.pathogen))


@check(
    "studies_per_country",
    """
select country, count(distinct unique_id) + max(case when unique_id is null then 1 else 0 end) as number_of_studies
from fx_spatial group by 1""",
)
def _(s: Survey) -> DataFrame:
    return s.spatial.groupBy("country").agg(
        n_distinct_or_missing(F.col("unique_id")).alias("number_of_studies")
    )


@check(
    "running_total_of_sites",
    """
select country, number, cast(sum(number) over (order by country rows unbounded preceding) as bigint) as total
from (select country, count(*) as number from fx_spatial group by 1)""",
)
def _(s: Survey) -> DataFrame:
    return with_running_total(count_by(s.spatial, "country"), ascending("country"), "number", "total")


@check(
    "numbered_sites",
    "select ord, unique_id, row_number() over (order by unique_id nulls last, ord) as id from fx_spatial",
)
def _(s: Survey) -> DataFrame:
    return with_row_id(s.spatial.select("ord", "unique_id"), ascending("unique_id", "ord"))


@check(
    "sites_in_countries",
    "select ord, country from fx_spatial where country in (select n_name from nation join region on n_regionkey = r_regionkey where r_name = 'AFRICA')",
)
def _(s: Survey) -> DataFrame:
    africa = s.table("region").filter(F.col("r_name") == "AFRICA")
    names = s.table("nation").join(africa, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name")
    return filter_in(s.spatial.select("ord", "country"), "country", names)


@check(
    "site_labels",
    "select ord, 'Study ID: ' || coalesce(cast(unique_id as varchar), 'NA') || '<br>' || town_village as label from fx_spatial",
)
def _(s: Survey) -> DataFrame:
    label = popup_label(K.LABEL_STUDY, F.col("unique_id"), K.BREAK, F.col("town_village"))
    return s.spatial.select("ord", label.alias("label"))
