import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trapline.llm.mixing import exponent_for, mix


@pytest.fixture
def shares(spark):
    return spark.createDataFrame([(0.6,), (0.3,), (0.08,), (0.02,)], "share double")


def test_exponent_meets_the_repetition_limit(shares):
    a = exponent_for(shares, repeat_limit=4)
    assert (0.02 / 0.6) ** (a - 1) == pytest.approx(4, rel=1e-4) and (0.02 / 0.6) ** (a - 1) <= 4
    assert exponent_for(shares, repeat_limit=1) == 1.0 and exponent_for(shares, repeat_limit=1_000) == 0.0
    assert exponent_for(shares, repeat_limit=None) == 1.0
    b = exponent_for(shares, repeat_limit=3, budget=1.5)
    weights = [p**b for p in (0.6, 0.3, 0.08, 0.02)]
    assert max(w / sum(weights) * 1.5 / p for w, p in zip(weights, (0.6, 0.3, 0.08, 0.02))) == pytest.approx(3, rel=1e-4)


@pytest.mark.parametrize("target", [1.0, 1.2, 1.38])
def test_exponent_meets_the_entropy(shares, target):
    a = exponent_for(shares, target_entropy=target)
    weights = [p**a for p in (0.6, 0.3, 0.08, 0.02)]
    weights = [w / sum(weights) for w in weights]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(target, abs=1e-4)


def test_exponent_beyond_reach(shares):
    assert exponent_for(shares, target_entropy=9) == 0.0 and exponent_for(shares, target_entropy=0.1) == 1.0


@pytest.fixture(scope="module")
def corpus():
    sizes = {"big": 400, "mid": 90, "small": 12}
    return [(i, "w " * (3 + i * 7 % 40), "en", s) for i, s in enumerate([s for s, n in sizes.items() for _ in range(n)])]


def test_every_document_is_read_and_quotas_are_filled(documents, corpus):
    rows = mix(documents(corpus), 4).collect()
    epochs, tokens, words = defaultdict(list), Counter(), {d[0]: len(d[1].split()) for d in corpus}
    for r in rows:
        epochs[r.doc_id].append(r.epoch)
        tokens[r.source] += r.n_tokens
        assert r.n_tokens == words[r.doc_id] and 0 <= r.start_token and r.start_token + r.n_tokens <= r.quota and 0 <= r.mix_at < 1
    assert set(epochs) == {d[0] for d in corpus}
    assert all(sorted(e) == list(range(len(e))) for e in epochs.values())
    quotas = {r.source: r.quota for r in rows}
    natural = Counter()
    for d in corpus:
        natural[d[3]] += words[d[0]]
    assert quotas["big"] == natural["big"] and quotas["small"] == pytest.approx(4 * natural["small"], rel=1e-3)
    assert all(quotas[s] - 50 * 21 <= tokens[s] <= quotas[s] for s in quotas)


def test_an_epoch_reads_each_document_once_without_gaps_in_an_order_of_its_own(documents, corpus):
    rows = [r for r in mix(documents(corpus), 4).collect() if r.source == "small"]
    orders = []
    for epoch in range(3):
        own = sorted((r for r in rows if r.epoch == epoch), key=lambda r: r.start_token)
        assert len(own) == 12
        assert all(a.start_token + a.n_tokens == b.start_token for a, b in zip(own, own[1:]))
        orders.append([r.block for r in own])
    assert len({tuple(o) for o in orders}) > 1


def test_a_stretch_of_the_mix_has_the_sources_in_proportion(documents, corpus):
    rows = sorted(mix(documents(corpus), 4).collect(), key=lambda r: r.mix_at)
    whole, half = Counter(), Counter()
    for r in rows:
        whole[r.source] += r.n_tokens
        if r.mix_at < 0.5:
            half[r.source] += r.n_tokens
    assert all(half[s] / sum(half.values()) == pytest.approx(whole[s] / sum(whole.values()), abs=0.05) for s in whole)


def test_a_budget_below_the_data(documents, corpus):
    rows = mix(documents(corpus), 2, budget_tokens=3_000).collect()
    assert 2_000 < sum(r.n_tokens for r in rows) <= 3_000 and len({r.source for r in rows}) == 3


def test_same_rows_for_any_partitioning(documents, corpus):
    results = [sorted(map(tuple, mix(documents(corpus, parts), 3, keep=["text"]).collect())) for parts in (1, 7)]
    assert results[0] == results[1]


def test_odd_rows(documents):
    data = [(1, "a b", "en", None), (None, "c", "en", None), (2, None, "en", "s"), (3, "", "en", "s"), (4, "d " * 60_000, "en", "t"), (1, "a b", "en", None), (5, "", "en", "?")]
    docs = documents(data).withColumns({"epoch": F.lit("x"), "tokens": F.lit("y")})
    rows = mix(docs, 2).collect()
    first = Counter((r.doc_id, r.source, r.n_tokens) for r in rows if r.epoch == 0)
    assert first == {(1, None, 2): 2, (None, None, 1): 1, (2, "s", 0): 1, (3, "s", 0): 1, (4, "t", 60_000): 1, (5, "?", 0): 1}
    assert mix(documents([])).count() == 0


def test_plan_is_native(small_documents):
    plan = mix(small_documents, keep=["text"])._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop", "SinglePartition"))
