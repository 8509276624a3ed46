"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits stands for a text. Two fingerprints that differ in at most four bits differ in at
most two bits in one of their halves, so they meet under some value at most one bit away from that half in
both. Every distinct fingerprint therefore enters the tables of both halves under the 33 values of
that small ball; what meets there is compared over all 64 bits. Within one table entry a search over the
members keeps one chain of links, not all pairs, so a group of thousands of near-copies yields as many links as
members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trapline.llm.graph import connected_components
from trapline.session import settle

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
_SLICE = 1 << 16  # shingles whose bits are counted at a time
_HALF = 32


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; 0 for a text without words.

    A-Z are lower-cased, words are runs without ASCII white space. A bit is set if it is set in over half of the
    XXH64 hashes of the word shingles, repeats counted; fewer words than a shingle's form one shingle.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(words, len(found)) - 1
    spans = list(zip(starts.tolist(), ends[last:].tolist()))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _SLICE):
        part = spans[at : at + _SLICE]
        hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``text_hash`` (XXH64) and ``fingerprint`` (bigint) of every row, whole texts read in Arrow batches."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["doc_id", "text_hash", "fingerprint"]
            )

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.encode(F.col(text), "UTF-8").alias("text")
    )
    return rows.mapInArrow(compute, "doc_id bigint, text_hash bigint, fingerprint bigint")


def _chain(prints: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links (smallest, other) that connect fingerprints exactly as all close pairs would."""
    rest = np.unique(prints)
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= max_bits
            hits, rest = rest[near], rest[~near]
            for other in hits:
                yield root, other
            queue.extend(hits)


def _match(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints under one table value; rows come sorted by value."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        found: set[tuple[int, int]] = set()
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            found.update(_chain(prints[s:e], max_bits))
        pairs = np.array(sorted(found), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held.append((keys, prints.view(np.uint64)))
        if len(keys) and keys[-1] != held[0][0][0]:
            keys, prints = (np.concatenate(x) for x in zip(*held))
            open_from = np.searchsorted(keys, keys[-1])
            yield links(keys[:open_from], prints[:open_from])
            held = [(keys[open_from:], prints[open_from:])]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def close_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a``, ``b`` between distinct ``fingerprint`` values that connect all within ``max_bits`` bits."""
    if not 0 <= max_bits < 6:
        raise ValueError("two halves with balls of one bit on both sides find at most five bits")
    ball = F.array(*[F.lit(m) for m in [0, *(1 << i for i in range(_HALF))]])
    low = F.col("fingerprint").bitwiseAND(F.lit((1 << _HALF) - 1))
    high = F.shiftrightunsigned("fingerprint", _HALF)
    values = F.concat(
        F.transform(ball, lambda m: low.bitwiseXOR(m)),
        F.transform(ball, lambda m: high.bitwiseXOR(m) + F.lit(1 << _HALF)),
    )
    table = prints.select("fingerprint").distinct().select(F.explode(values).alias("value"), "fingerprint")
    met = table.repartition("value").sortWithinPartitions("value")
    return met.mapInArrow(lambda b: _match(b, max_bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fingerprint`` and ``component_id`` (smallest id reachable) of every document.

    A missing text counts as empty; texts without words have fingerprint 0 and are linked like others.
    Rows with equal id or text are kept as they are, in one component. A row without id is linked to nothing
    and has no component.
    """
    prints = settle(with_fingerprint(docs, doc_id, text, words))
    known = prints.filter("doc_id is not null")
    classes = connected_components(close_fingerprints(known, max_bits))
    owners = known.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    labelled = settle(
        owners.join(classes, owners["fingerprint"] == classes["node"], "left")
        .select("fingerprint", "least_id", F.coalesce("component", "fingerprint").alias("component"))
    )
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = labelled.join(least, "component").select("fingerprint", "component_id")
    joined = known.join(ids, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id")
    return joined.unionByName(
        prints.filter("doc_id is null").withColumn("component_id", F.lit(None).cast("bigint"))
    )
