import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm.ann import Graph, nearest

VECTOR = "vec_id bigint, embedding array<float>"


def plain(data, is_query, k):
    rows = {i: np.array(v, np.float32).astype(float) for i, v in data if i is not None and usable(v)}
    out = {}
    for q in rows:
        if is_query(q):
            near = sorted((-float(v @ rows[q]), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_over_several_shards_and_query_blocks(spark, monkeypatch):
    from trapline.llm import ann

    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    random = np.random.default_rng(3)
    centres = random.normal(size=(30, 24))
    data = [(i, (centres[i % 30] + random.normal(size=24) * random.uniform(0.3, 2)).tolist()) for i in range(3_000)]
    vectors = spark.createDataFrame(data, VECTOR).repartition(4)
    result = found(nearest(vectors, F.col("vec_id") % 20 == 0, k=20, shard=800))
    expected = plain(data, lambda i: i % 20 == 0, 20)
    assert set(result) == set(expected)
    hits = sum(len({i for i, _ in expected[q]} & {i for _, i, _ in result[q]}) for q in expected)
    assert hits >= 0.95 * 20 * len(expected)
    scores = {i: np.array(v, np.float32).astype(float) for i, v in data}
    for q, rows in result.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and q not in {i for _, i, _ in rows}
        assert all(s == pytest.approx(float(scores[q] @ scores[i]), abs=1e-9) for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)


def test_ties_copies_and_unusable_vectors(spark):
    data = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [3.0, 1.0]), (101, [0.5, 0.5]), (120, [2.0]), (140, [4.0]), (160, [0.1, 9.0])]
    data += [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [float("nan"), 1.0]), (280, [float("inf"), 1.0]), (300, []), (None, [1.0, 1.0])]
    data += [(0, [1.0, 0.0]), (20, [1.0, 0.0])]
    vectors = spark.createDataFrame(data, VECTOR).repartition(3).withColumns({"score": F.lit("x"), "ids": F.lit(1)})
    result = found(nearest(vectors, F.col("vec_id") % 20 == 0, k=20, shard=10))
    expected = plain(data, lambda i: i % 20 == 0, 20)
    assert {q: [(i, s) for _, i, s in rows] for q, rows in result.items()} == expected
    assert len(expected[120]) == 1 and 220 not in result and 200 not in result


def test_too_few_rows(spark):
    assert nearest(spark.createDataFrame([], VECTOR), F.lit(True)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0])], VECTOR), F.lit(True)).count() == 0
    assert nearest(spark.createDataFrame([(1, [1.0]), (2, [2.0])], VECTOR), F.lit(False)).count() == 0


def test_pruned_graph_is_sparse_and_navigable():
    random = np.random.default_rng(0)
    points = random.normal(size=(1_500, 16))
    graph = Graph(points).build()
    degrees = (graph.edges[:-1] < 1_500).sum(axis=1)
    assert degrees.max() <= graph.edges.shape[1] and degrees.min() >= 1
    near = graph.search(np.concatenate([points, np.zeros((1_500, 1))], axis=1).astype(np.float32), 80, [graph.entry])
    exact = np.argsort(-(points @ points.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) for a, b in zip(exact, near)]) > 9
