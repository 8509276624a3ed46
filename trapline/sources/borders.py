"""Border files: polygons as text in, one row per region, and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions.geometry import ring_from_geojson, ring_from_wkt, ring_to_geojson, ring_to_wkt

FORMS = ("geojson", "geojsonl", "wkt")
_SEPARATOR = "\t"


def _known(form: str) -> None:
    if form not in FORMS:
        raise ValueError(f"border files are {', '.join(FORMS)}, not {form!r}")


def _feature(properties: Mapping[str, str]) -> str:
    fields = ", ".join(f"`{theirs}`: string" for theirs in properties)
    return f"struct<properties: struct<{fields}>, geometry: string>"


def load_borders(spark: SparkSession, path: str, properties: Mapping[str, str], form: str = "geojson") -> DataFrame:
    """Regions of a border file, or of a directory of files, one per country: the named properties as text, and ``ring``.

    ``properties`` maps the file's names to the table's. ``geojson``: feature collections, a file being one task, as it is one
    document; ``geojsonl``: a feature per line, with or without a record separator in front, which Spark splits; ``wkt``: lines with a
    header, separated by tabs, the outline in column ``geometry``. A feature whose outline is no polygon keeps its
    properties and has no ``ring``; a line or file that is no such text gives a row of missing values, or for ``wkt`` what could be read.
    """
    _known(form)
    named = [F.col(f"f.properties.{theirs}").alias(ours) for theirs, ours in properties.items()]
    reader = spark.read.option("recursiveFileLookup", "true")
    if form == "wkt":
        lines = reader.option("header", "true").option("sep", _SEPARATOR).option("maxCharsPerColumn", "-1").csv(path)
        return lines.select(*[F.col(t).alias(o) for t, o in properties.items()], ring_from_wkt(F.col("geometry")).alias("ring"))
    if form == "geojson":
        files = reader.text(path, wholetext=True)
        parsed = F.from_json("value", f"features array<{_feature(properties)}>")["features"]
        features = files.select(F.explode_outer(F.filter(parsed, lambda f: f.isNotNull())).alias("f"))
    else:
        lines = reader.text(path).select(F.regexp_replace("value", r"^\x1e", "").alias("value")).filter(F.trim("value") != "")
        features = lines.select(F.from_json("value", _feature(properties)).alias("f"))
    return features.select(*named, ring_from_geojson(F.col("f.geometry")).alias("ring"))


def _geojson_line(properties: Sequence[str]) -> Column:
    known = F.to_json(F.struct(*[F.col(c) for c in properties]), {"ignoreNullFields": "false"})
    return F.concat(
        F.lit('{"type":"Feature","properties":'), known, F.lit(',"geometry":'), F.coalesce(ring_to_geojson("ring"), F.lit("null")), F.lit("}")
    )


def write_borders(df: DataFrame, path: str, properties: Sequence[str], form: str = "geojsonl", mode: str = "error") -> None:
    """Write ``properties`` and ``ring`` as border files that ``load_borders`` reads back; numbers keep all their digits.

    ``geojson`` writes a collection per partition, ``geojsonl`` and ``wkt`` lines.
    """
    _known(form)
    if form == "wkt":
        lines = df.select(*properties, ring_to_wkt("ring").alias("geometry"))
        lines.write.mode(mode).option("header", "true").option("sep", _SEPARATOR).csv(path)
        return
    lines = df.select(_geojson_line(properties).alias("value"))
    if form == "geojson":
        lines = lines.groupBy(F.spark_partition_id().alias("part")).agg(
            F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value")
        ).select("value")
    lines.write.mode(mode).text(path)
