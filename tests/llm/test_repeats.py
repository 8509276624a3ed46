import collections
import hashlib
import random

import pytest

from trapline.llm import repeats
from trapline.llm.repeats import remove_repeats, widest_repeats


def plain(texts, length=400):
    """Every window of every text by the letter."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(d, covered) if not c)
        spans = sum(c and not p for p, c in zip([0, *covered], covered))
        out.append((len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, length=400, **options):
    rows = remove_repeats(df, length, **options).collect()
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def expected(data, length=400):
    return sorted((i is not None, i or 0, *row) for (i, _), row in zip(data, plain([t for _, t in data], length)))


def words(pick, count):
    return " ".join("".join(pick.choice("abcdefgé") for _ in range(pick.randrange(2, 9))) for _ in range(count))


def corpus(seed):
    pick = random.Random(seed)
    shared = [words(pick, n) for n in (30, 58, 62, 70, 100, 250)]
    data = []
    for i in range(70):
        parts = []
        for _ in range(pick.randrange(1, 4)):
            parts.append(words(pick, pick.randrange(0, 60)))
            if pick.random() < 0.7:
                passage = pick.choice(shared)
                if pick.random() < 0.5:  # part of a passage, so that repeats of different extent overlap
                    a, b = sorted(pick.sample(range(len(passage)), 2))
                    passage = passage[a:b]
                if pick.random() < 0.3 and len(passage) > 3:
                    at = pick.randrange(len(passage))
                    passage = passage[:at] + "#" + passage[at + 1 :]
                parts.append(passage)
        data.append((i, " ".join(parts)))
    return data


@pytest.mark.parametrize("seed, group", [(1, 4_096), (2, 4_096), (3, 4), (4, 0)])
def test_equals_every_window_by_the_letter(documents, seed, group):
    data = corpus(seed)
    assert found(documents(data), group=group) == expected(data)


def test_copies_periods_and_short_texts(documents):
    pick = random.Random(5)
    base = words(pick, 200)
    data = [(1, base), (2, base), (2, base), (3, base + " x"), (4, "y " + base), (5, None), (6, ""), (7, "z" * 399), (8, "z" * 400), (9, "z" * 401)]
    data += [(10, "ab" * 900), (11, "q" * 3_000 + words(pick, 80)), (None, words(pick, 90)), (None, base[100:700]), (12, "é" * 250)]
    assert found(documents(data)) == expected(data)
    alone = [(1, "k" * 800), (2, words(pick, 300))]
    assert found(documents(alone)) == expected(alone)


def test_texts_in_several_pieces(documents, monkeypatch):
    pick = random.Random(6)
    passage = words(pick, 120)
    long = words(pick, 700) + passage + words(pick, 900) + passage[50:] + words(pick, 100)
    data = [(1, long), (2, words(pick, 30) + passage), (3, long[2_000:2_900]), (4, words(pick, 40))]
    columns = None
    for piece in (1_000, 3_333):
        monkeypatch.setattr(repeats, "PIECE", piece)
        rows = []
        batch = repeats.pa.RecordBatch.from_pydict({"key": [bytes([i]) for i, _ in data], "text": [t for _, t in data]})
        for out in repeats._find_anchors(400)([batch]):
            rows += out.to_pylist()
        columns = collections.Counter((r["gram"], r["m1"], r["m2"]) for r in rows if r["gram"] is not None)
        windows = collections.Counter()
        for r in rows:
            if r["gram"] is not None and r["n"] == 1:
                windows[r["key"]] += r["end"] - r["start"] - 399
        for i, t in data:  # every window of every text lies in a stretch, but for the parts' overlap
            assert windows[bytes([i])] >= len(t.encode()) - 399 or len(t.encode()) < 400
    assert columns


def test_intervals_find_every_occurrence():
    pick = random.Random(7)
    for _ in range(300):
        lefts = [bytes(pick.choice(b"ab") for _ in range(pick.randrange(0, 7))) for _ in range(pick.randrange(0, 14))]
        rights = [bytes(pick.choice(b"ab") for _ in range(pick.randrange(1, 7))) for _ in lefts]
        reach = []
        for x in range(len(lefts)):
            best = (0, 0)
            for y in range(len(lefts)):
                left, right = repeats._common(lefts[x], lefts[y]), repeats._common(rights[x], rights[y])
                if x != y and left + right >= 5:
                    best = (max(best[0], left), max(best[1], right))
            reach.append(best)
        assert widest_repeats(lefts, rights, 5) == reach


def test_empty_table_and_extra_columns(spark, documents):
    assert remove_repeats(documents([])).count() == 0
    extra = spark.createDataFrame([(1, "a" * 500, "k", 3)], "doc_id bigint, text string, key string, start int")
    assert found(extra) == expected([(1, "a" * 500)])
