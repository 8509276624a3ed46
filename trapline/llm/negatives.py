"""Hard negatives: rows of another label that score in a band below an anchor's best rows of its own label.

Scores are whole numbers, inner products of vectors whose components are floored after scaling. Candidates are dealt into
blocks, anchors stream past every block, and a block hands on only pairs that can still count: the best positives,
then, once the positives of all blocks are known, the best negatives of every band. These pairs take part in a secondary
sort: they are dealt by anchor and sorted by (anchor, descending score, id) within partitions, and an
iterator over the sorted rows opens a window at every positive and emits the negatives that fall into it.
Of an anchor it holds the open windows only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import settle

BLOCK_ROWS = 65_536  # candidates one task holds at a time
SCALE = 256.0
_CELLS = 1 << 22  # scores computed at once
_EXACT = float(1 << 53)  # doubles below are exact whole numbers
_LONG = 9e18

_PAIR = "anchor_id bigint, score bigint, kind int, vec_id bigint"
_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``embedding`` of the rows that take part, one per id.

    Rows without id, label or vector, and vectors with a missing or non-finite component, take no part, nor do vectors so
    long that their product with themselves is no 64-bit number. Of rows that share an id the least by label and vector is taken.
    """
    product = F.aggregate(
        F.transform("embedding", lambda x: (F.abs(x.cast("double")) * SCALE + 1) * (F.abs(x.cast("double")) * SCALE + 1)),
        F.lit(0.0), lambda total, x: total + x,
    )
    whole = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding"
    ).filter(
        "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x))"
    )
    kept = whole.filter(product < _LONG)
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")


def _rows(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    """Floored vectors of the rows ``at``, which all have ``dim`` components."""
    starts = column.offsets.to_numpy()[at]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values[starts[:, None] + np.arange(dim)] * SCALE)


class _Block:
    """Candidates of one block by length, in order of label and id, so that a label is one slice."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        parts: dict[int, list] = {}
        for batch in batches:
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                parts.setdefault(dim, []).append((ids[at], labels[at], _rows(batch.column("embedding"), at, dim)))
        self.by_dim = {}
        for dim, held in parts.items():
            ids, labels, vectors = (np.concatenate(p) for p in zip(*held))
            order = np.lexsort((ids, labels))
            self.by_dim[dim] = ids[order], labels[order], vectors[order]

    def scores(self, anchors: pa.RecordBatch) -> Iterator[tuple]:
        """Per anchor: its place in the batch, the candidates' ids, their scores, and where the anchor's label begins and ends."""
        column, labels = anchors.column("embedding"), anchors.column("label").to_numpy()
        lengths = np.diff(column.offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            if dim not in self.by_dim:
                continue
            ids, theirs, vectors = self.by_dim[dim]
            places = np.flatnonzero(lengths == dim)
            step = max(1, _CELLS // max(len(ids), 1))
            for start in range(0, len(places), step):
                at = places[start : start + step]
                asked = _rows(column, at, dim)
                largest = dim * float(np.abs(asked).max(initial=0)) * float(np.abs(vectors).max(initial=0))
                if largest < _EXACT:
                    scores = (asked @ vectors.T).astype(np.int64)
                else:
                    scores = asked.astype(np.int64) @ vectors.astype(np.int64).T
                low, high = np.searchsorted(theirs, labels[at], "left"), np.searchsorted(theirs, labels[at], "right")
                for row, place in enumerate(at.tolist()):
                    yield place, ids, scores[row], int(low[row]), int(high[row])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
        return np.concatenate([above, level])
    return np.arange(len(scores))


def _scorer(choose: Callable) -> Callable:
    """Rows of a partition come by block, candidates first; anchors then stream past the candidates held."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, number = [], None, None
        for batch in batches:
            marks = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                piece, mark = batch.slice(start, end - start), int(marks[start])
                piece = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], schema=piece.schema)
                if mark // 2 != number:
                    held, block, number = [], None, mark // 2
                if mark % 2 == 0:
                    held.append(piece)
                    continue
                if block is None:
                    block, held = _Block(held), []
                yield choose(block, piece)

    return score


def _pairs(anchors: list, scores: list, kind: int, ids: list) -> pa.RecordBatch:
    total = [np.concatenate(part) if part else np.zeros(0, np.int64) for part in (anchors, scores, ids)]
    return pa.RecordBatch.from_arrays(
        [pa.array(total[0]), pa.array(total[1]), pa.array(np.full(len(total[0]), kind, np.int32)), pa.array(total[2])],
        names=["anchor_id", "score", "kind", "vec_id"],
    )


def _choose_positives(k: int) -> Callable:
    def choose(block: _Block, anchors: pa.RecordBatch) -> pa.RecordBatch:
        names, out = anchors.column("vec_id").to_numpy(), ([], [], [])
        for place, ids, scores, low, high in block.scores(anchors):
            same, own = ids[low:high], scores[low:high]
            other = same != names[place]
            same, own = same[other], own[other]
            best = _best(same, own, k)
            out[0].append(np.full(len(best), names[place]))
            out[1].append(own[best])
            out[2].append(same[best])
        return _pairs(out[0], out[1], 0, out[2])

    return choose


def _choose_negatives(k: int) -> Callable:
    def choose(block: _Block, anchors: pa.RecordBatch) -> pa.RecordBatch:
        names, out = anchors.column("vec_id").to_numpy(), ([], [], [])
        bands = anchors.column("bands").to_pylist()
        for place, ids, scores, low, high in block.scores(anchors):
            others, score = np.concatenate([ids[:low], ids[high:]]), np.concatenate([scores[:low], scores[high:]])
            picked = []
            for band in bands[place]:
                inside = np.flatnonzero((score >= band["low"]) & (score <= band["high"]))
                picked.append(inside[_best(others[inside], score[inside], k)])
            best = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
            out[0].append(np.full(len(best), names[place]))
            out[1].append(score[best])
            out[2].append(others[best])
        return _pairs(out[0], out[1], 1, out[2])

    return choose


def _score(candidates: DataFrame, anchors: DataFrame, blocks: int, choose: Callable) -> DataFrame:
    """Pairs that ``choose`` keeps of every anchor and every block; a partition per block."""
    own = candidates.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "label", "embedding",
        F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("bands"),
    )
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "label", "embedding", "bands"
    )
    dealt = own.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")
    return dealt.mapInArrow(_scorer(choose), _PAIR)


def _windows(positives: int, negatives: int, low: int, high: int) -> Callable:
    """Secondary sort's iterator: rows come by anchor and falling score, a positive before negatives of its score."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, opened, windows = None, 0, []
        for batch in batches:
            out = []
            for name, score, kind, vec_id in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if name != anchor:
                    anchor, opened, windows = name, 0, []
                if kind == 0:
                    if opened < positives:
                        windows.append([vec_id, score, 0])
                        opened += 1
                    continue
                spent = False
                for window in windows:
                    if low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((name, window[0], window[2], vec_id, window[1], score))
                        spent |= window[2] == negatives
                if spent:
                    windows = [w for w in windows if w[2] < negatives]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return mine


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The first ``negatives`` rows of other labels in the band below each of an anchor's first ``positives`` rows of its label.

    ``vectors`` holds ``vec_id``, ``label``, ``embedding``; other columns are left out. Components x count as floor(256 x), a score is the
    inner product with the anchor, higher scores come first, ties go to the smaller id. A negative fits a positive if its score lies between
    ``low`` and ``high`` hundredths of the positive's. Fewer rows than asked for: all of them. An anchor is not its own
    positive; an anchor without positives, or positives without negatives, give no row, nor does an empty table. Only vectors of equal length
    are compared. See ``usable`` for the rows that take no part.
    """
    rows = settle(usable(vectors))
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / block_rows))
    anchors = rows.filter(is_anchor)
    no_bands = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = settle(
        _score(rows, anchors.withColumn("bands", no_bands), blocks, _choose_positives(positives))
        .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives).drop("place")
    )
    # A band is empty below zero. Products with the bounds stay exact as decimals.
    band = F.struct(
        F.ceil(F.col("score").cast("decimal(20,0)") * low / 100).cast("bigint").alias("low"),
        F.floor(F.col("score").cast("decimal(20,0)") * high / 100).cast("bigint").alias("high"),
    )
    bands = best.filter("score >= 0").groupBy("anchor_id").agg(F.collect_set(band).alias("bands"))  # at most one per positive
    asking = anchors.join(bands, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    pairs = best.unionByName(_score(rows, asking, blocks, _choose_negatives(negatives)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, "anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "kind", "vec_id")
    return dealt.mapInArrow(_windows(positives, negatives, low, high), _MINED)


SQL = """
with q as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
 from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
 from q a join q b on a.vec_id <> b.vec_id and a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
 qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as int) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 10"""
