"""Token counts with a cache of counted contents.

Texts are normalised without changing their tokens and named by a SHA-256 digest; a tokenizer is named by
the digest of its file. Digests that the cache table does not hold are encoded once each, however many rows
share them, and appended to it. Rows then take their counts from the cache by an equi-join.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"
LIMIT = 2048
WORDS_HELD = 300_000  # counted words a worker remembers; then it starts anew


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _between_white_space(spec: dict) -> bool:
    """Whether a tokenizer drops white space before it splits words, so that no token spans any."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = steps[0] if steps else {}
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and r"\s" in first["pattern"].get("Regex", "") and bool(spec["model"].get("end_of_word_suffix"))
    )


@cache
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Function from texts to their numbers of tokens, as the file's library counts them."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)

    def whole(texts: list[str]) -> list[int]:
        return [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as file:
        if not _between_white_space(json.load(file)):
            return whole
    known: dict[str, int] = {"": 0}

    def by_word(texts: list[str]) -> list[int]:
        counts = []
        for text in texts:
            words = text.split(" ")
            new = [w for w in set(words) if w not in known]
            if len(known) > WORDS_HELD:
                known.clear()
                known[""] = 0
                new = list(set(words) - {""})
            known.update(zip(new, whole(new)))
            counts.append(sum(map(known.__getitem__, words)))
        return counts

    return by_word


def normalised(text: Column) -> Column:
    """Text with runs of ASCII white space as one space, none at its ends; a missing text is empty.

    Tokenizers that drop white space give both forms the same tokens.
    """
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r" *[\t\n\r][ \t\n\r]*| {2,}", " "))


def count_tokens(
    docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = LIMIT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row, through the cache at ``cache_path``.

    ``cache_path`` is a folder that driver and executors share; it is made if there is none. A missing text counts as
    empty, with no bytes and no tokens. Rows with equal id or text each get a row. Texts of tokenizers that do not drop
    white space are named as they are. No special tokens are added; their strings inside texts
    are what the library makes of them. Tokenizer files lie at the same path on every machine.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    if tokenizer_path.endswith(".json"):
        with open(tokenizer_path, encoding="utf-8") as file:
            form = normalised if _between_white_space(json.load(file)) else (lambda c: F.coalesce(c, F.lit("")))
    else:
        form = lambda c: F.coalesce(c, F.lit(""))
    content = F.unhex(F.sha2(form(F.col(text)), 256))

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
    contents = docs.select(content.alias("content"), form(F.col(text)).alias("text")).dropDuplicates(["content"])
    misses = contents.join(stored, "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for batch in batches:
            counts = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(counts)), pa.array(counts, pa.int64())],
                names=["content", "tokenizer", "n_tokens"],
            )

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    # Two jobs may have appended the same digest; the counts are equal then.
    counts = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        .filter(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    )
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        content.alias("content"),
    )
    return rows.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
