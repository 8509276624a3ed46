"""Corpus pipeline: stages over ``documents``, each stored as Parquet and read again by the next.

Language identification, near-duplicates, benchmark decontamination, personal data, mixing. Every stage but the last returns
the columns it was given. Missing values, repeated rows and empty tables pass as each stage's text says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import show_package
from trapline.llm.decontaminate import contaminated
from trapline.llm.langid import UNDETERMINED, fit, identify
from trapline.llm.mixing import mix
from trapline.llm.pii import redact
from trapline.llm.simhash import near_duplicates
from trapline.session import settle

REPEAT_LIMIT = 2.0  # a source is read at most twice as often as the one with most tokens
_HASH = "__text_hash"
_MIX_COLUMNS = ("doc_id", "source", "epoch", "block", "n_tokens", "start_token", "quota", "mix_at")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; a missing ``lang`` becomes the predicted one. Texts without letters go."""
    found = identify(docs.withColumn("__lang", F.col("lang")), fit(docs)).filter(F.col("lang_pred") != UNDETERMINED)
    return found.withColumn("lang", F.coalesce("__lang", "lang_pred")).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-copies; of several texts under that id one. Rows without id all stay."""
    keepers = near_duplicates(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    same = ["doc_id", _HASH]  # texts under one id are told apart by their hash, so that they are moved once
    hashed = docs.withColumn(_HASH, F.xxhash64("text"))
    kept = hashed.join(keepers.withColumnRenamed("text_hash", _HASH), same, "left_semi").dropDuplicates(same).drop(_HASH)
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without id stay."""
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, ``n_chars`` as it is then."""
    changed = redact(docs)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, once per epoch, with their place in it; every document is read at least once."""
    return mix(docs, REPEAT_LIMIT, keep=[c for c in docs.columns if c not in _MIX_COLUMNS])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", without_copies),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]

# SQL expresses neither language identification nor fingerprints; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    show_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs)
    return docs
