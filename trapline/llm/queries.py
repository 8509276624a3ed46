"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import decontaminate, mixing, negatives, prefixes, repeats, show_package
from trapline.llm.ann import nearest
from trapline.llm.html_text import extract
from trapline.llm.langid import fit, held_out, identify
from trapline.llm.negatives import hard_negatives
from trapline.llm.passages import repeated_passages
from trapline.llm.pii import BASE_KINDS, detect, span_text
from trapline.llm.simhash import near_duplicates
from trapline.llm.tokens import count_tokens
from trapline.llm.warc import read_archives, write_archives
from trapline.session import new_folder


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    show_package(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_mixing(spark: SparkSession, directory: str) -> DataFrame:
    """Reading order of all documents in which no source is repeated more than four times as often as the largest."""
    return mixing.mix(_table(spark, directory, "documents"))


def op2_simhash(spark: SparkSession, directory: str) -> DataFrame:
    """Component of near-copies of every document."""
    found = near_duplicates(_table(spark, directory, "documents")).drop("text_hash")
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op3_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest(_table(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_html(spark: SparkSession, directory: str) -> DataFrame:
    """Main text of every page."""
    return extract(_table(spark, directory, "pages"))


def op5_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.contaminated(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))


def op6_pii(spark: SparkSession, directory: str) -> DataFrame:
    """Personal data in every document."""
    spans, _ = detect(_table(spark, directory, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = {f"n_{k}": number(k) for k in BASE_KINDS}
    return spans.withColumns(counts).select(
        "doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def op7_warc(spark: SparkSession, directory: str) -> DataFrame:
    """Every page, written to archives in the shared folder and read back."""
    folder = new_folder(spark)
    manifest = write_archives(_table(spark, directory, "pages"), folder)
    return read_archives(manifest).drop("url", "payload")


def op8_language(spark: SparkSession, directory: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = _table(spark, directory, "documents")
    texts = docs.select("doc_id", "text")
    return identify(texts, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_tokens(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens of every document. The cache starts empty, so that every content is encoded."""
    import public_tokenizers

    cache = new_folder(spark)
    return count_tokens(_table(spark, directory, "documents"), cache, public_tokenizers.path("word_bpe_49k.json"))


def op10_passages(spark: SparkSession, directory: str) -> DataFrame:
    """Passages of 50 words or more that repeat, with the occurrence that stays."""
    return repeated_passages(_table(spark, directory, "documents"))


def op11_prefixes(spark: SparkSession, directory: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt with the openings of every hundredth one."""
    return prefixes.prefix_trie(prefixes.with_shared_openings(_table(spark, directory, "conversations")))


def op12_repeats(spark: SparkSession, directory: str) -> DataFrame:
    """What strings of 400 bytes that start twice cover in every document."""
    return repeats.remove_repeats(_table(spark, directory, "documents"), with_text=False).drop("spans")


def op13_negatives(spark: SparkSession, directory: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh row's label is moved on by one first."""
    vectors = _table(spark, directory, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_neighbours": op3_neighbours,
    "op4_html": op4_html,
    "op5_decontaminate": op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_tokens": op9_tokens,
    "op10_passages": op10_passages,
    "op11_prefixes": op11_prefixes,
    "op12_repeats": op12_repeats,
    "op13_negatives": op13_negatives,
}
SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op11_prefixes": prefixes.SQL,
    "op12_repeats": repeats.SQL,
    "op13_negatives": negatives.SQL,
}
