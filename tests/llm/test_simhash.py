import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trapline.llm.graph import connected_components
from trapline.llm.simhash import close_fingerprints, fingerprint, near_duplicates


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize(
    "text", [None, "", " \n\t", "one", "One TWO", "a b c d", "a b c d e", "É é É é x", "x" * 50_000, "w " * 70_000, "a\x0bb\x0cc\xa0d e"]
)
def test_fingerprint_by_the_letter(text):
    found = fingerprint(text.encode() if text is not None else None)
    assert found & (2**64 - 1) == plain_fingerprint(text)


def test_components_against_brute_force(documents):
    pick = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    data = []
    for i in range(60):
        base = [pick.choice(words) for _ in range(pick.choice([2, 30, 80]))]
        data.append((len(data) * 3, " ".join(base)))
        for _ in range(pick.choice([0, 0, 1, 4])):
            copy = list(base)
            copy[pick.randrange(len(copy))] = pick.choice(words)
            data.append((len(data) * 3, " ".join(copy)))
    data += [(9_000, None), (9_001, ""), (9_001, ""), (9_002, "  "), (None, data[0][1])]
    prints = {i: plain_fingerprint(t) for i, t in data if i is not None}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = plain_components(links, ids)
    rows = near_duplicates(documents(data)).collect()
    assert len(rows) == len(data)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint & (2**64 - 1), r.component_id) == (prints[r.doc_id], expected[r.doc_id])
    assert expected[9_002] == 9_000


def test_links_connect_exactly_what_is_close(spark):
    random_bits = np.random.default_rng(1)
    centre = int(random_bits.integers(0, 2**63))
    values = {centre}
    for _ in range(1_500):  # one crowded neighbourhood
        flips = random_bits.integers(0, 64, random_bits.integers(1, 7))
        values.add(centre ^ int(np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64))))
    values |= {int(v) for v in random_bits.integers(0, 2**63, 300)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    links = close_fingerprints(prints)
    nodes = np.array(signed, np.int64).view(np.uint64)
    close = [(signed[i], signed[j]) for i in range(len(nodes)) for j in np.flatnonzero(np.bitwise_count(nodes[i + 1 :] ^ nodes[i]) <= 4) + i + 1]
    expected = plain_components(close, signed)
    found = dict(connected_components(links).collect())
    assert {v: found.get(v, v) for v in signed} == expected
    assert links.count() < 66 * len(values) < len(close) * 2


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1_000, 1_000 + i) for i in range(1, 400)]
    data = [*chain, *star, (5_000, 5_000), (None, 1), (1_399, 1_000), (1_399, 1_000)]
    found = dict(connected_components(spark.createDataFrame(data, "a bigint, b bigint").repartition(4)).collect())
    assert found == {i: 0 for i in range(201)} | {1_000 + i: 1_000 for i in range(400)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty_table_and_extra_columns(documents):
    assert near_duplicates(documents([])).count() == 0
    extra = documents([(1, "a b c d e")]).withColumns({"fingerprint": F.lit("x"), "component_id": F.lit("y")})
    assert [tuple(r)[0] for r in near_duplicates(extra).collect()] == [1]
