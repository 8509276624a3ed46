"""Repeated strings of bytes: every byte that lies in a string of a given length which starts anywhere else too.

Sorting every suffix of a corpus would move many times its size, so suffixes enter the suffix array only at anchors: the
position whose 128-byte string has the least hash in a window. Equal windows choose the same anchor, so no repeat is missed. A run of
windows with one anchor is a stretch of text; stretches are compared by hash first. What is left are anchors whose string
recurs with other text around it. Their suffixes make an enhanced suffix array per anchor string: sorted right contexts with the
lengths of their common prefixes. A scan with a stack walks its tree of common-prefix intervals from the leaves up. Where
children of an interval meet, their left contexts are merged in order; members of different children agree to the right as
far as the interval goes, and the text by which their left contexts differ bounds the repeat on the left. So every occurrence of every
maximal repeat is found, not only those of neighbours in the array.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.session import settle, settle_by

MIN_BYTES = 400
GRAM = 128  # bytes of an anchor string, a power of two
PIECE = 1 << 22  # bytes hashed at once
GROUP = 1_024  # suffixes of one anchor string that a task compares; beyond, windows are compared by hash

_PLACE = 24  # low bits of a window's choice hold the place, the others the hash
_ANCHORS = "gram bigint, m1 bigint, m2 bigint, n bigint, key binary, start bigint, at bigint, end bigint"
_SUFFIX = "gram bigint, open boolean, key binary, start bigint, at bigint, bytes binary"
_WINDOW = "w1 bigint, w2 bigint, key binary, start bigint"
_SPAN = "key binary, start bigint, end bigint"
_CUT = "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every position on, put together from hashes of halves."""
    out, step = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), 1
    out ^= out >> np.uint64(29)
    factor = 0xD6E8FEB86659FD93
    while step < GRAM:
        out = out[:-step] * np.uint64(factor) + out[step:]
        out ^= out >> np.uint64(31)
        factor, step = factor * 0x2545F4914F6CDD1D % (1 << 64) | 1, step * 2
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def _runs(data: np.ndarray, borders: list[tuple[int, int]], length: int) -> tuple[np.ndarray, ...]:
    """First and last window of every run with one anchor, the anchor, and its hash; windows stay inside ``borders``."""
    hashes = _hashes(data)
    choice = hashes >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (_least(choice, length - GRAM + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    valid = np.zeros(len(anchors) + 2, bool)  # with an invalid window at either end
    for low, high in borders:
        valid[low + 1 : max(high - length, low - 1) + 2] = True
    changes = np.concatenate([[True], anchors[1:] != anchors[:-1], [True]])
    starts = np.flatnonzero(valid[1:-1] & (~valid[:-2] | changes[:-1]))
    ends = np.flatnonzero(valid[1:-1] & (~valid[2:] | changes[1:]))
    return starts, ends, anchors[starts], hashes[anchors[starts]]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Parts of the texts' bytes to hash at once: begin, end, and (text, begin, end) inside. Longer texts come in overlapping parts."""
    row, count = 0, len(offsets) - 1
    while row < count:
        begin, inside = int(offsets[row]), []
        if int(offsets[row + 1]) - begin > PIECE:
            end = int(offsets[row + 1])
            for low in range(begin, end - length + 1, PIECE - length):
                high = min(low + PIECE - 1, end)
                yield low, high, [(row, low, high)]
                if high == end:
                    break
            row += 1
            continue
        while row < count and int(offsets[row + 1]) - begin <= PIECE:
            inside.append((row, int(offsets[row]), int(offsets[row + 1])))
            row += 1
        yield begin, inside[-1][2], inside


def _batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema)], names=[n for n, _ in schema])


_LONG, _BYTES = pa.int64(), pa.binary()
_ANCHOR_COLUMNS = [(n, _BYTES if n == "key" else _LONG) for n in ("gram", "m1", "m2", "n", "key", "start", "at", "end")]
_SPAN_COLUMNS = [("key", _BYTES), ("start", _LONG), ("end", _LONG)]


def _find_anchors(length: int) -> Callable:
    """One row per stretch of a text, and per part of it that repeats in the text itself one without ``gram``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text")
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            held = texts.buffers()[2]
            whole = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
            for begin, end, inside in _pieces(offsets, length):
                if end - begin < length:
                    continue
                data = whole[begin:end]
                starts, ends, anchors, hashes = _runs(data, [(low - begin, high - begin) for _, low, high in inside], length)
                if not len(starts):
                    continue
                view, digest = memoryview(data), xxhash.xxh3_128_digest
                marks = b"".join([digest(view[s : e + length]) for s, e in zip(starts.tolist(), ends.tolist())])
                m = np.frombuffer(marks, np.int64).reshape(-1, 2)
                firsts = np.array([low - begin for _, low, _ in inside])
                text = np.searchsorted(firsts, starts, "right") - 1
                rows = np.array([row for row, _, _ in inside])[text]
                shift = begin - offsets[rows].astype(np.int64)  # from places in the piece to places in the text
                starts, ends, anchors = starts + shift, ends + shift + length, anchors + shift
                order = np.lexsort((starts, m[:, 1], m[:, 0], rows))
                same = (rows[order][1:] == rows[order][:-1]) & np.all(m[order][1:] == m[order][:-1], axis=1)
                head = np.flatnonzero(np.concatenate([[True], ~same]))
                counts = np.diff(np.append(head, len(order)))
                kept = order[head]
                yield _batch(_ANCHOR_COLUMNS, [
                    hashes[kept].astype(np.int64), m[kept, 0], m[kept, 1], counts, [keys[r] for r in rows[kept].tolist()],
                    starts[kept], anchors[kept], ends[kept],
                ])
                twice = np.sort(order[np.repeat(counts > 1, counts)])
                if len(twice):
                    apart = (starts[twice][1:] > ends[twice][:-1]) | (rows[twice][1:] != rows[twice][:-1])
                    cuts = np.concatenate([[True], apart, [True]])
                    low, high = twice[np.flatnonzero(cuts[:-1])], twice[np.flatnonzero(cuts[1:])]
                    nothing = [None] * len(low)
                    yield _batch(_ANCHOR_COLUMNS, [nothing] * 4 + [[keys[r] for r in rows[low].tolist()], starts[low], nothing, ends[high]])

    return find


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings share at the front."""
    size = min(len(a), len(b))
    a, b = a[:size], b[:size]
    return size if a == b else size - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def widest_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int]]:
    """How far each suffix reaches to the left and the right in repeats of at least ``length`` bytes that hold its anchor.

    ``rights`` begin at the anchor, ``lefts`` are what is before it, reversed. (0, 0): in no repeat. Intervals of common
    prefixes are visited from the leaves up; in each, members are kept in the order of their left contexts, and when
    the smaller of two children joins the larger, only members that become neighbours can reach further than before.
    """
    reach_left, reach_right = [0] * len(lefts), [0] * len(lefts)

    def meet(x: int, y: int, right: int) -> None:
        left = _common(lefts[x], lefts[y])
        if left + right >= length:
            for member in (x, y):
                reach_left[member] = max(reach_left[member], left)
                reach_right[member] = max(reach_right[member], right)

    def join(one: list, other: list, right: int) -> list:
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        for entry in small:
            at = bisect_left(large, entry)
            if at:
                meet(large[at - 1][1], entry[1], right)
            if at < len(large):
                meet(large[at][1], entry[1], right)
            large.insert(at, entry)
        return large

    longest = max(map(len, lefts), default=0)
    intervals: list[list] = []
    prefixes: list[int] = []  # common prefix of each interval on the stack with the one below it
    before = None
    for member in sorted(range(len(rights)), key=rights.__getitem__):
        prefix = _common(before, rights[member]) if before is not None else 0
        while prefixes and prefixes[-1] >= prefix:
            shared, top = prefixes.pop(), intervals.pop()
            intervals[-1] = join(intervals[-1], top, shared)
        if prefix + longest < length:  # no repeat is long enough from here up
            intervals, prefixes = [], []
        elif intervals:
            prefixes.append(prefix)
        intervals.append([(lefts[member], member)])
        before = rights[member]
    while prefixes:
        shared, top = prefixes.pop(), intervals.pop()
        intervals[-1] = join(intervals[-1], top, shared)
    return list(zip(reach_left, reach_right))


def _cut_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches asked for, from their texts."""
    names = [("gram", _LONG), ("open", pa.bool_()), ("key", _BYTES), ("start", _LONG), ("at", _LONG), ("bytes", _BYTES)]
    for batch in batches:
        out, size = [[] for _ in names], 0
        for key, text, asks in zip(*(batch.column(c) for c in ("key", "text", "asks"))):
            data = text.as_buffer()
            for ask in asks.as_py():
                row = (ask["gram"], ask["open"], key.as_py(), ask["start"], ask["at"], data[ask["start"] : ask["end"]].to_pybytes())
                for column, value in zip(out, row):
                    column.append(value)
                size += len(row[-1])
            if size > PIECE:
                yield _batch(names, out)
                out, size = [[] for _ in names], 0
        yield _batch(names, out)


def _compare(length: int) -> Callable:
    """Spans of open stretches that repeat; the stretches of an anchor string come one after another."""

    def spans(group: list[tuple]) -> Iterator[tuple[bytes, int, int]]:
        lefts = [row[4][: row[3] - row[2]][::-1] for row in group]
        rights = [row[4][row[3] - row[2] :] for row in group]
        for (is_open, key, _, at, _), (left, right) in zip(group, widest_repeats(lefts, rights, length)):
            if is_open and right:
                yield key, at - left, at + right

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, group = None, []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "open", "key", "start", "at", "bytes"))):
                if row[0] != gram:
                    found += spans(group)
                    gram, group = row[0], []
                group.append(row[1:])
            yield _batch(_SPAN_COLUMNS, list(zip(*found)) or [[], [], []])
        yield _batch(_SPAN_COLUMNS, list(zip(*spans(group))) or [[], [], []])

    return compare


def _hash_windows(length: int) -> Callable:
    """Every window of a stretch by its hash."""
    names = [("w1", _LONG), ("w2", _LONG), ("key", _BYTES), ("start", _LONG)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, data in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "bytes"))):
                places = range(len(data) - length + 1)
                marks = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i : i + length]) for i in places]), np.int64).reshape(-1, 2)
                yield _batch(names, [marks[:, 0], marks[:, 1], [key] * len(places), np.arange(start, start + len(places))])

    return windows


def _cut(length: int, with_text: bool) -> Callable:
    """Texts without their repeats."""
    span = pa.list_(pa.struct([("start", _LONG), ("end", _LONG)]))
    names = [("key", _BYTES), ("n_bytes", _LONG), ("n_removed", _LONG), ("n_spans", _LONG), ("kept_sha256", pa.string()), ("spans", span), ("kept", _BYTES)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [[] for _ in names], 0
            for key, text, copies, found in zip(*(batch.column(c) for c in ("key", "text", "copies", "spans"))):
                data, runs = memoryview(text.as_buffer()), []
                if copies.as_py() > 1 and len(data) >= length:
                    runs = [[0, len(data)]]
                else:
                    for start, end in sorted((s["start"], s["end"]) for s in found.as_py() or []):
                        if runs and start <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], end)
                        else:
                            runs.append([start, end])
                edges = [0, *(e for run in runs for e in run), len(data)]
                parts, digest = [data[a:b] for a, b in zip(edges[::2], edges[1::2])], hashlib.sha256()
                for part in parts:
                    digest.update(part)
                kept = b"".join(parts) if with_text else None
                row = (
                    key.as_py(), len(data), sum(e - s for s, e in runs), len(runs), digest.hexdigest(),
                    [{"start": s, "end": e} for s, e in runs], kept,
                )
                for column, value in zip(out, row):
                    column.append(value)
                size += len(kept or b"")
                if size > PIECE:
                    yield _batch(names, out)
                    out, size = [[] for _ in names], 0
            yield _batch(names, out)

    return cut


def remove_repeats(docs: DataFrame, length: int = MIN_BYTES, with_text: bool = True, group: int = GROUP) -> DataFrame:
    """Documents without the bytes covered by a string of ``length`` bytes that also starts anywhere else, the same document included.

    Per row of ``docs(doc_id, text)``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` of what is left,
    ``spans`` with byte positions, and, if asked for, what is ``kept`` as bytes, as cuts need not fall between characters. Strings do not cross
    documents and are judged on the texts as given; overlapping occurrences count. Missing texts count as empty. Rows that repeat
    a text are copies of each other, whatever their ids; a missing id stays missing; texts under ``length`` lose nothing. Other columns are
    left out. ``length`` must be larger than ``GRAM``. No rows: none.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"), text.alias("text"))
    texts = settle_by(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "key")

    anchors = settle(texts.select("key", "text").mapInArrow(_find_anchors(length), _ANCHORS))
    marks = anchors.filter("gram is not null")
    grams = marks.groupBy("gram").agg(F.sum("n").alias("total")).filter("total > 1").select("gram")
    shared = settle(marks.join(grams, "gram"))
    stretch = ["gram", "m1", "m2"]
    classes = settle(shared.groupBy(*stretch).agg(F.sum("n").alias("n"), F.min(F.struct("key", "start", "at", "end")).alias("first")))
    equal = shared.join(classes.filter("n > 1").select(*stretch), stretch).select("key", "start", "end")

    mixed = classes.groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1")
    asks = classes.join(mixed, "gram").select("gram", "members", (F.col("n") == 1).alias("open"), "first.*")

    def suffixes(some: DataFrame) -> DataFrame:
        by_text = some.groupBy("key").agg(F.collect_list(F.struct("gram", "open", "start", "at", "end")).alias("asks"))
        return texts.select("key", "text").join(by_text.hint("shuffle_hash"), "key").mapInArrow(_cut_suffixes, _SUFFIX)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = suffixes(asks.filter(F.col("members") <= group)).repartition(parts, "gram").sortWithinPartitions("gram")
    unequal = few.mapInArrow(_compare(length), _SPAN)
    windows = settle(suffixes(asks.filter(F.col("members") > group)).mapInArrow(_hash_windows(length), _WINDOW))
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    crowded = windows.join(again, ["w1", "w2"]).select("key", "start", (F.col("start") + length).alias("end"))

    inside = anchors.filter("gram is null").select("key", "start", "end")
    spans = inside.unionByName(equal).unionByName(unequal).unionByName(crowded)
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    done = texts.join(by_text.hint("shuffle_hash"), "key", "left").mapInArrow(_cut(length, with_text), _CUT)
    found = keyed.select("doc_id", "key").join(done, "key").drop("key")
    return found if with_text else found.drop("kept")


# Every window of every document in standard SQL, on hexadecimal digits.
SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select r, x, unnest(range(0, cast(length(x) / 2 as bigint) - 399)) as i from d where length(x) >= 800),
m as (select r, i, md5(substr(x, 2 * i + 1, 800)) as m from w),
c as (select r, i from m where m in (select m from m group by m having count(*) > 1)),
f as (select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then 0 else 1 end as fresh from c),
g as (select r, i, sum(fresh) over (partition by r order by i rows unbounded preceding) as run from f),
s as (select r, run, min(i) as a, max(i) + 400 as b from g group by 1, 2),
k as (select s.r, s.a, s.b, substr(d.x, 2 * coalesce(lag(s.b) over (partition by s.r order by s.a), 0) + 1,
  2 * (s.a - coalesce(lag(s.b) over (partition by s.r order by s.a), 0))) as piece from s join d on d.r = s.r),
t as (select r, sum(b - a) as n_removed, count(*) as n_spans, string_agg(piece, '' order by a) as kept, max(b) as last from k group by 1)
select d.doc_id, cast(length(d.x) / 2 as bigint) as n_bytes, cast(coalesce(t.n_removed, 0) as bigint) as n_removed, coalesce(t.n_spans, 0) as n_spans,
 sha256(unhex(coalesce(t.kept, '') || substr(d.x, 2 * coalesce(t.last, 0) + 1))) as kept_sha256
from d left join t on t.r = d.r"""
