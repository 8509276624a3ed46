"""Survey tables with declared schemas."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trapline.functions.geometry import RING, point_x, point_y
from trapline.operators.order import with_running_total
from trapline.session import parts_for

_POINT_COLUMNS = "lon double, lat double"

_DDL = {
    "studies": "unique_id string, title string, country string, journal_name string, "
    "year_published bigint, aim string, detailed_aim_1 string, detailed_aim_2 string, link string",
    "studies_all": "unique_id string, speciation string, aim string, trapping_effort string",
    "spatial": f"ord bigint, unique_id string, country string, {_POINT_COLUMNS}, aim string, "
    "trap_period string, town_village string, trap_nights bigint",
    "species": "ord bigint, unique_id string, genus string, classification string, "
    f"presence_absence string, number bigint, {_POINT_COLUMNS}, pa_colour string, "
    "town_village string, trap_nights bigint",
    "rodent_summary": "genus string, classification string, trap_habitat string",
    "pathogen": "ord bigint, unique_id string, country string, iso3c string, "
    "classification string, pathogen_group string, pathogen_clean string, pathogen_tested string, "
    f"assay string, number bigint, samples_tested bigint, {_POINT_COLUMNS}, pa_colour string, "
    "town_village string, year_trapping bigint, month string",
    "level_0": f"gid_0 string, name_0 string, ring {RING}",
    "level_2": f"region_id string, name_2 string, ring {RING}",
    # What site_density_by_region writes, to be drawn many times.
    "level_2_sites": f"region_id string, name_2 string, ring {RING}, n bigint, n_studies bigint, "
    "n_known_studies bigint, area_m2 double, sites_per_km2 double, density_class int",
}
_DDL["species_prepared"] = _DDL["species"].replace("trap_nights bigint", "trap_nights string")
_DDL["pathogen_prepared"] = _DDL["pathogen"]


def table_schema(name: str) -> StructType:
    """Declared schema of a survey table."""
    if name not in _DDL:
        raise KeyError(f"unknown table {name!r}; known: {', '.join(sorted(_DDL))}")
    return StructType.fromDDL(_DDL[name])


def conform(df: DataFrame, schema: StructType, name: str) -> DataFrame:
    """Select and cast the declared columns; a missing one is an error, not a column of nulls."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {name!r} lacks columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def with_file_order(stored: DataFrame, name: str = "ord") -> DataFrame:
    """Number the rows of Parquet files 1, 2, … by file name, then by place in the file, however the files are split.

    ``stored`` is a DataFrame as it was read. Every file's rows are counted first; only one total per file is sorted.
    """
    rows = stored.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    sizes = rows.groupBy("__file").agg((F.max("__place") + 1).alias("__rows"))
    ends = with_running_total(sizes, [F.col("__file")], "__rows", "__end")
    starts = ends.select("__file", (F.col("__end") - F.col("__rows")).alias("__start"))
    number = F.col("__start") + F.col("__place") + 1
    return rows.join(starts, "__file").select(*stored.columns, number.alias(name))


def laid_out(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows dealt over as many files as ``parts_for`` says, in ranges of ``columns``, sorted by them.

    A choice of their values then reaches few files and row groups. End with a column that tells the rows of one value
    apart, so that a value that holds most of the rows is spread.
    """
    keys = list(columns)
    return df.repartitionByRange(parts_for(df), *keys).sortWithinPartitions(*keys)


def load_table(
    spark: SparkSession,
    directory: str,
    name: str,
    schema: StructType | str | None = None,
    suffix: str = ".parquet",
) -> DataFrame:
    """Read ``directory/name + suffix`` (a file or a directory of files) as a declared table.

    A declared ``ord`` that the files lack is the order of the files and of the rows in them.
    """
    if schema is None:
        schema = table_schema(name)
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    stored = spark.read.parquet(f"{directory.rstrip('/')}/{name}{suffix}")
    if "ord" in schema.fieldNames() and "ord" not in stored.columns:
        stored = with_file_order(stored)
    return conform(stored, schema, name)


def union_regions(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack per-country region tables, matching columns by name."""
    return reduce(DataFrame.unionByName, frames)


def load_regions(
    spark: SparkSession, directory: str, schema: StructType | None = None
) -> DataFrame:
    """Read a directory of per-country region files in one scan."""
    stored = spark.read.option("recursiveFileLookup", "true").parquet(directory)
    return conform(stored, schema or table_schema("level_2"), directory)


def with_lon_lat(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Replace a WKT point column by ``lon`` and ``lat``."""
    point = F.col(geometry)
    return df.withColumns({"lon": point_x(point), "lat": point_y(point)}).drop(geometry)
