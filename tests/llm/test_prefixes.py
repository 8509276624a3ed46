import hashlib
import random
import zlib

import pytest

from trapline.llm.prefixes import NODES, _medians, _Tree, prefix_trie, with_shared_openings
from trapline.llm.queries import op11_prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(data):
    """Every conversation's turns after the rule of shared openings."""
    turns = {}
    for conv_id, turn, role, text in data:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns.setdefault(conv_id, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(v, key=lambda t: t[:3])] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = set()
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    order = sorted(members, key=len, reverse=True)
    leaves, saved = {}, {}
    for node in order:
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = sum(saved[b] for b in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(sequences[c]) == len(node))
        rows.add((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows


def found(df):
    rows = [tuple(r[c] for c in NODES) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some(pick, conversations, texts, longest):
    return [
        (c, t, pick.choice(["user", "assistant"]), pick.choice(texts)) for c in conversations for t in range(pick.randrange(1, longest + 1))
    ]


@pytest.mark.parametrize("seed, shard_turns", [(1, 1_000_000), (2, 40), (3, 15)])
def test_equals_brute_force_for_any_shards(spark, seed, shard_turns):
    pick = random.Random(seed)
    data = some(pick, range(0, 240), ["a", "bb", "ccc", "é😀", ""], 6)
    data += [(300 + c, t, "user", "copy") for c in range(150) for t in range(4)]  # a hot group of copies, over several shards
    data += [(1_000, t, "user", "copy" if t < 3 else f"long {t}") for t in range(120)]
    sequences = with_shared_openings(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert found(prefix_trie(sequences, shard_turns)) == plain(rebuilt(data))


def test_leaves_that_go_on_in_the_next_shard(spark):
    data = [(c, 0, "user", "same") for c in range(7, 90, 7)] + [(c, t, "user", "same") for c in range(2_001, 2_040, 3) for t in range(2)]
    for shard_turns in (1, 3, 9):
        sequences = with_shared_openings(spark.createDataFrame(data, SCHEMA))
        assert found(prefix_trie(sequences, shard_turns)) == plain(rebuilt(data))


def test_odd_rows(spark):
    data = [
        (1, None, "user", "first"), (1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (1, 2, "", "x"), (None, 0, "user", "nobody"),
        (2, 5, "ab", "c"), (3, 5, "a", "bc"), (101, 0, "user", "z"), (-7, 0, "user", "below zero"), (0, 0, "user", "b"), (100, None, None, None),
    ]
    data += [(250, 0, "user", "x" * 200_000), (251, 0, "user", "x" * 200_000)]
    extra = spark.createDataFrame([(*d, "?", 1) for d in data], SCHEMA + ", path string, depth int").repartition(3)
    expected = plain(rebuilt(data))
    assert found(prefix_trie(with_shared_openings(extra))) == expected
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in expected)  # a conversation without turns


def test_empty_table(spark):
    assert prefix_trie(with_shared_openings(spark.createDataFrame([], SCHEMA))).count() == 0


def test_search_trees_are_balanced():
    assert sorted(_medians(1_000)) == list(range(1_000)) and next(_medians(9)) == 4
    tree = _Tree()
    for place in _medians(1_000):
        tree.insert([place, 5], [1, 1])
    depth = [0] * len(tree.turn)
    for node in range(1, len(tree.turn)):
        for side in (tree.below[node], tree.above[node]):
            if side:
                depth[side] = depth[node] + 1
    assert max(depth) < 11 and len(tree.turn) == 2_001


def test_query(spark, small_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_prefixes(spark, small_dir)) == plain(rebuilt(data))
