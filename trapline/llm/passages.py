"""Repeated passages: near-duplicate paragraphs by MinHash banding, and stretches that repeat inside other text.

Paragraphs (lines of at least 50 words) get MinHash signatures of their five-word shingles, cut into as many bands as a wanted recall
needs. Distinct paragraphs that collide in a band are joined and compared by exact Jaccard similarity. In a crowded
bucket they are first compared with one of them; then only those that are still in different components, and have enough in common
with other texts at all, are compared with each other. A group of copies costs as many comparisons as members, and no link is lost.

A passage may also sit in the middle of a line. Of all ten-word sequences each document offers the one with the least hash in every eleven
in a row, so that two documents that share twenty words share one. Sequences met in two documents are put
together to stretches; every repeated run of 50 words is found.

Both kinds of links are clustered to components. Of each component the occurrence in the smallest document stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trapline.llm.graph import connected_components
from trapline.session import settle

SHINGLE, SIMILARITY, MIN_WORDS = 5, 0.8, 50
ROWS_PER_BAND, MISSED = 3, 1e-4  # share of pairs at the similarity that no band may find
SEQUENCE, EVERY = 10, 11
MIN_STRETCH = MIN_WORDS - 2 * (EVERY - 1)  # words of a run of MIN_WORDS that its sequences cover at least
STAR_ROUNDS = 2
_AT_ONCE = 4_096  # shingles hashed at a time
_BLOCK = 256  # expected members of a bucket that are compared with each other and with as many others at a time
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS_PER_BAND, missed: float = MISSED) -> int:
    """Bands of ``rows`` hashes that leave at most ``missed`` of the pairs at ``similarity`` without a collision."""
    return math.ceil(math.log(missed) / math.log(1 - similarity**rows))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _PRIME
    return values ^ (values >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _sequences(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every sequence of ``length`` words; shorter texts have one of all their words."""
    length = min(length, len(words))
    total = np.zeros(len(words) - length + 1, np.uint64)
    for at in range(length):
        total = total * _PRIME + words[at : at + len(total)]
    return _mixed(total)


def shingles_of(words: list[bytes]) -> np.ndarray:
    """Distinct hashed five-word shingles."""
    return np.unique(_sequences(_word_hashes(words), SHINGLE))


@cache
def _parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(5)
    return random.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, count, np.uint64)


def band_values(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """A 64-bit value per band of the MinHash signatures of texts, whose shingles begin at ``starts``."""
    factors, offsets = _parameters(bands * rows)
    least = np.empty((len(starts), bands * rows), np.uint64)
    ends = np.append(starts[1:], len(shingles))
    first = 0
    while first < len(starts):  # as many texts at a time as fit, at least one
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _AT_ONCE, "right")))
        low, high = starts[first], ends[last - 1]
        whole = None
        for at in range(low, high, _AT_ONCE):
            part = shingles[at : min(high, at + _AT_ONCE), None] * factors + offsets
            if last - first > 1:
                whole = np.minimum.reduceat(part, starts[first:last] - low)
            else:
                whole = part.min(axis=0, keepdims=True) if whole is None else np.minimum(whole, part.min(axis=0))
        least[first:last] = whole
        first = last
    total = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(starts), 1))
    for column in range(rows):
        total = _mixed(total * _PRIME + least[:, column::rows])
    return total


def _lines(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """First word's number and words of every line that is long enough."""
    start = 0
    for line in text.split(b"\n"):
        words = line.split()
        if len(words) >= MIN_WORDS:
            yield start, words
        start += len(words)


def _paragraph_id(words: list[bytes]) -> int:
    return int(np.uint64(xxh64_intdigest(b" ".join(words))).astype(np.int64))


def _mapped(docs: DataFrame, make: Callable[[int, bytes], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that ``make`` yields for every document (id, lower-cased text), in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.extend(make(doc, text))
                if len(held) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return docs.mapInArrow(run, ddl)


def _paragraphs(docs: DataFrame, bands: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("pid", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def make(doc: int, text: bytes) -> Iterator[tuple]:
        lines = list(_lines(text))
        if lines:
            sequences = [_sequences(_word_hashes(words), SHINGLE) for _, words in lines]
            starts = np.cumsum([0, *map(len, sequences[:-1])])
            values = band_values(np.concatenate(sequences), starts, bands).view(np.int64)
            for (start, words), own in zip(lines, values):
                yield doc, start, len(words), _paragraph_id(words), own

    return _mapped(docs, make, schema, "doc_id bigint, start int, n_words int, pid bigint, bands array<bigint>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("pid", pa.int64()), ("line", pa.binary())])

    def make(_: int, text: bytes) -> Iterator[tuple]:
        for _, words in _lines(text):
            yield _paragraph_id(words), b" ".join(words)

    return _mapped(docs, make, schema, "pid bigint, line binary")


def _with_sets(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(line.split()).view(np.int64) for line in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["pid", "shingles"])

    return lines.mapInArrow(run, "pid bigint, shingles array<bigint>")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


def _shared(table: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of ``table`` whose ``key`` is met with two different values of ``value``; sorted by key in their partition."""

    def keep(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        at, other = columns[names.index(key)], columns[names.index(value)]
        starts, ends = _runs(at)
        mixed = np.minimum.reduceat(other, starts) != np.maximum.reduceat(other, starts)
        kept = np.repeat(mixed, ends - starts)
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        names: list[str] = []
        for batch in batches:
            if not len(batch):
                continue
            names = batch.schema.names
            spot = names.index(key)
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if held[-1][spot][-1] != held[0][spot][0]:
                columns = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(columns[spot], columns[spot][-1]))
                yield keep([c[:cut] for c in columns], names)
                held = [[c[cut:] for c in columns]]
        if held:
            yield keep([np.concatenate(c) for c in zip(*held)], names)

    return table.repartition(key).sortWithinPartitions(key).mapInArrow(run, table.schema)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    left = sets.select(F.col("pid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("pid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _shared_counts(sets: DataFrame) -> DataFrame:
    """``pid``, ``n`` (shingles) and ``m`` (those that another of the paragraphs has too) of every paragraph."""
    table = sets.select(F.explode("shingles").alias("shingle"), "pid")
    shared = _shared(table, "shingle", "pid").groupBy("pid").agg(F.count("*").alias("m"))
    return sets.select("pid", F.size("shingles").cast("bigint").alias("n")).join(shared, "pid")


def similar_paragraphs(docs: DataFrame, paragraphs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``a``, ``b`` that connect distinct paragraphs exactly as all similar pairs that share a band would.

    Two paragraphs have at most as many shingles in common as either shares with any other. Where that is too few for the
    similarity, a pair need not be compared: copies with many changes of their own drop out before they meet. A bucket's centre is the
    member with the fewest shingles of its own, which is the text that the others are copies of.
    """
    table = paragraphs.select("pid", F.explode("bands").alias("value")).distinct()
    met = settle(_shared(table, "value", "pid"))
    wanted = met.select("pid").distinct()
    lines = _shingle_sets(docs).join(wanted, "pid", "left_semi").dropDuplicates(["pid"])
    sets = settle(_with_sets(lines.select("pid", "line")))
    members = settle(met.join(_shared_counts(sets), "pid").filter(F.col("m") >= similarity * F.col("n")))
    enough = f"least(m, other_m) * {1 + similarity!r} >= {similarity!r} * (n + other_n) and component <> other_component"
    links: DataFrame | None = None
    labelled = members.withColumn("component", F.col("pid"))
    for number in range(STAR_ROUNDS):
        rank = F.struct((F.col("n") - F.col("m")).alias("own"), F.xxhash64("pid", F.lit(number)).alias("h"), "pid", "component", "n", "m")
        centres = labelled.groupBy("value").agg(F.min(rank).alias("c")).select(
            "value", *[F.col(f"c.{c}").alias(f"other_{c}") for c in ("pid", "component", "n", "m")]
        )
        pairs = labelled.join(centres, "value").filter(enough)
        pairs = pairs.select(F.greatest("pid", "other_pid").alias("a"), F.least("pid", "other_pid").alias("b")).distinct()
        found = settle(_similar(pairs, sets, similarity))
        links = found if links is None else links.unionByName(found)
        classes = connected_components(links).select(F.col("node").alias("pid"), F.col("component").alias("root"))
        labelled = settle(
            members.join(classes, "pid", "left").select("value", "pid", "n", "m", F.coalesce("root", "pid").alias("component"))
        )
    return links.unionByName(_links_left(labelled.select("value", "pid", "component"), sets, similarity))


def _links_left(labelled: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the components that still meet in a bucket, found without emitting pairs.

    Buckets with a single component are done. The others are cut into blocks of bounded size, any two of a bucket meet in one
    group, and a group yields a chain of links.
    """
    unsettled = _shared(labelled, "value", "component")
    sizes = unsettled.groupBy("value").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    dealt = unsettled.join(sizes, "value").withColumn("block", F.pmod(F.xxhash64("pid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("value", F.least("block", "other"), F.greatest("block", "other"))
    rows = dealt.select(group.alias("group"), "pid", "component").join(sets, "pid").select("group", "pid", "component", "shingles")

    def compare(members: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        members = list({m[0]: m for m in members}.values())
        pids, components = [m[0] for m in members], np.array([m[1] for m in members])
        lengths = np.array([len(m[2]) for m in members])
        known, back, times = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True, return_counts=True)
        owner, shared = np.repeat(np.arange(len(members)), lengths), times[back] > 1
        owner, back = owner[shared], back[shared]
        common = np.zeros((len(members), len(members)), np.float32)
        for at in range(0, len(known), _AT_ONCE):
            inside = (back >= at) & (back < at + _AT_ONCE)
            marks = np.zeros((len(members), _AT_ONCE), np.float32)
            marks[owner[inside], back[inside] - at] = 1
            common += marks @ marks.T
        close = common >= similarity * (lengths[:, None] + lengths - common)
        close |= components[:, None] == components
        left = np.ones(len(members), bool)
        while left.any():
            queue = [int(np.argmax(left))]
            left[queue[0]] = False
            while queue:
                near = queue.pop()
                hits = np.flatnonzero(close[near] & left)
                left[hits] = False
                queue.extend(hits.tolist())
                yield from ((pids[near], pids[hit]) for hit in hits if components[near] != components[hit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            found = []
            shingles = batch.column(3)
            for at, (name, pid, component) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                if name != key and held:
                    found.extend(compare(held))
                    held = []
                key = name
                held.append((pid, component, shingles[at].values.to_numpy()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
        if held and (found := list(compare(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return settle(rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a bigint, b bigint"))


def _apart(places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for a place whose hash the one before has too, unless it is needed to reach ``EVERY`` places on.

    A text that repeats a word offers a place every so often then, not every one.
    """
    keep = np.ones(len(places), bool)
    if (hashes[1:] != hashes[:-1]).all():
        return keep
    last = 0
    for at in range(1, len(places) - 1):
        if hashes[at] == hashes[last] and places[at + 1] - places[last] <= EVERY:
            keep[at] = False
        else:
            last = at
    return keep


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``run``, ``start``, ``n_words``, ``sequence``, ``first``: sequences of every stretch that another document has too.

    A stretch begins at ``run`` and goes on as long as sequences of any role do. It comes in parts (``start``, ``n_words``): those whose
    sequences no earlier document has in a stretch (``first``), and those that one has.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("sequence", pa.int64())])

    def make(doc: int, text: bytes) -> Iterator[tuple]:
        words = text.split()
        if len(words) >= MIN_STRETCH:
            hashes = _sequences(_word_hashes(words), SEQUENCE)
            rows = np.lib.stride_tricks.sliding_window_view(hashes, min(EVERY, len(hashes)))
            places = np.unique(rows.argmin(axis=1) + np.arange(len(rows)))
            places = places[_apart(places, hashes[places])]
            yield from zip([doc] * len(places), places.tolist(), hashes[places].view(np.int64).tolist())

    offered = _mapped(docs, make, schema, "doc_id bigint, place int, sequence bigint")
    met = settle(_shared(offered, "sequence", "doc_id"))

    def long_enough(columns: list[np.ndarray]) -> list[np.ndarray]:
        doc, place, sequence = columns
        starts, ends = _cut((np.diff(doc) != 0) | (np.diff(place) > EVERY))
        kept = np.repeat(place[ends - 1] + SEQUENCE - place[starts] >= MIN_STRETCH, ends - starts)
        return [c[kept] for c in (doc, np.repeat(place[starts], ends - starts), place, sequence)]

    held = "doc_id bigint, run int, place int, sequence bigint"
    first_pass = _by_document(met.select("doc_id", "place", "sequence"), ["place"], long_enough, held).drop("run")
    # A sequence counts only if two stretches that are long enough have it.
    long = settle(_by_document(_shared(first_pass, "sequence", "doc_id"), ["place"], long_enough, held))
    firsts = long.groupBy("sequence").agg(F.min("doc_id").alias("least"))
    roles = long.join(firsts, "sequence").select("doc_id", "run", "place", "sequence", (F.col("doc_id") == F.col("least")).cast("int").alias("first"))

    def parts(columns: list[np.ndarray]) -> list[np.ndarray]:
        doc, run, place, sequence, first = columns
        whole = (np.diff(doc) != 0) | (np.diff(run) != 0)
        starts, ends = _cut(whole | (np.diff(first) != 0))
        stops = place[ends - 1] + SEQUENCE
        inner = ~whole[starts[1:] - 1]
        stops[:-1][inner] = np.maximum(stops[:-1], place[starts[1:]])[inner]  # no word between two parts is left out
        sizes = ends - starts
        return [doc, run, np.repeat(place[starts], sizes), np.repeat(stops - place[starts], sizes), sequence, first]

    found = _by_document(roles, ["run", "place"], parts, "doc_id bigint, run int, start int, n_words int, sequence bigint, first int")
    return found.withColumn("first", F.col("first") == 1)


def _cut(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(apart) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(apart) + 1]])


def _by_document(table: DataFrame, order: list[str], make: Callable[[list[np.ndarray]], list[np.ndarray]], ddl: str) -> DataFrame:
    """What ``make`` gives for the columns of whole documents, sorted by ``doc_id`` (the first column) and ``order``."""
    types = {"bigint": np.int64, "int": np.int32}
    fields = [(name, types[kind]) for name, kind in (f.split() for f in ddl.split(", "))]
    inputs = [types[kind] for _, kind in table.dtypes]

    def put(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, (_, t) in zip(make(columns), fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append([c.to_numpy(zero_copy_only=False).astype(t) for c, t in zip(batch.columns, inputs)])
            if held[-1][0][-1] != held[0][0][0]:
                columns = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                yield put([c[:cut] for c in columns])
                held = [[c[cut:] for c in columns]]
        if held:
            yield put([np.concatenate(c) for c in zip(*held)])

    return table.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(run, ddl)


def repeated_passages(
    docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per occurrence of a repeated passage: ``doc_id``, ``kind`` (paragraph or stretch), ``start`` (number of its first word),
    ``n_words``, ``component_id``, ``kept_doc_id``, ``keep``.

    Case and white space make no difference. ``keep`` marks the occurrence that stays, the first one in the smallest document; stretches
    stay where no earlier document has them. Missing and short texts have no passages. Rows without id take no part, rows that share one are
    one document.
    """
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.encode(F.lower(F.col(text)), "UTF-8").alias("text")
    )
    paragraphs = settle(_paragraphs(rows, bands_for(similarity)))
    stretches = settle(repeated_stretches(rows).withColumn("stretch", F.xxhash64("doc_id", "run")))
    least = stretches.groupBy("sequence").agg(F.min("stretch").alias("b"))
    shared = stretches.join(least, "sequence").select(F.col("stretch").alias("a"), "b").distinct()
    links = similar_paragraphs(rows, paragraphs, similarity).unionByName(shared)
    classes = connected_components(links).withColumnRenamed("node", "passage")

    places = paragraphs.select("doc_id", F.lit("paragraph").alias("kind"), "start", "n_words", F.col("pid").alias("passage"), F.lit(False).alias("first")).distinct()
    runs = stretches.select("doc_id", F.lit("stretch").alias("kind"), "start", "n_words", F.col("stretch").alias("passage"), "first").distinct()
    known = places.unionByName(runs).join(classes, "passage", "left").withColumn("component", F.coalesce("component", "passage"))
    known = settle(known)
    sizes = known.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("least"))
    repeated = known.join(sizes.filter("n > 1"), "component")
    keep = F.when(F.col("kind") == "stretch", F.col("first")).otherwise(
        (F.col("doc_id") == F.col("least.doc_id")) & (F.col("start") == F.col("least.start"))
    )
    return repeated.select(
        "doc_id", "kind", "start", "n_words", F.col("component").alias("component_id"),
        F.col("least.doc_id").alias("kept_doc_id"), keep.alias("keep"),
    )
