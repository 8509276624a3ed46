import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from trapline.llm.passages import ROWS_PER_BAND, band_values, bands_for, repeated_passages, shingles_of, similar_paragraphs, _paragraphs
from trapline.llm.graph import connected_components


def text(pick, words, vocabulary=5_000):
    return [f"w{pick.randrange(vocabulary)}" for _ in range(words)]


def repeats(data, length):
    seen = defaultdict(set)
    for doc, body in data:
        words = (body or "").lower().split()
        for i in range(len(words) - length + 1):
            seen[tuple(words[i : i + length])].add(doc)
    return {d for docs in seen.values() if len(docs) > 1 for d in docs}


def test_bands_meet_the_wanted_recall():
    assert (1 - 0.8**ROWS_PER_BAND) ** bands_for() <= 1e-4
    pick = random.Random(1)
    hits = 0
    for _ in range(60):
        base = text(pick, 200)
        copy = list(base)
        for at in pick.sample(range(200), 4):
            copy[at] = "other"
        a, b = (shingles_of([w.encode() for w in t]) for t in (base, copy))
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
            one, other = band_values(np.concatenate([a, b]), np.array([0, len(a)]), bands_for())
            assert (band_values(b, np.array([0]), bands_for())[0] == other).all()
            hits += bool((one == other).any())
        else:
            hits += 1
    assert hits == 60


def test_signatures_of_very_long_texts():
    random = np.random.default_rng(0)
    parts = [random.integers(0, 2**63, n, np.uint64) for n in (50, 9_000, 10, 4_096, 3)]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    together = band_values(np.concatenate(parts), starts, 7)
    assert all((band_values(p, np.array([0]), 7)[0] == t).all() for p, t in zip(parts, together))


def test_every_run_of_fifty_words_is_found_and_clean_documents_are_not(documents):
    pick = random.Random(5)
    data = [(i, " ".join(text(pick, pick.choice([20, 120, 400])))) for i in range(120)]
    for number in range(25):  # inside a line, at any place
        passage = text(pick, pick.choice([50, 51, 64, 150]))
        for i in pick.sample(range(120), pick.choice([2, 3, 20])):
            words = data[i][1].split()
            at = pick.randrange(len(words) + 1)
            data[i] = (i, " ".join(words[:at] + passage + words[at:]))
    data += [(200 + i, "common line of ten words that many other documents have\n" + " ".join(text(pick, 80))) for i in range(30)]
    data += [(300, None), (301, ""), (None, data[0][1]), (302, "the " * 50_000)]
    rows = repeated_passages(documents(data)).collect()
    found = {r.doc_id for r in rows}
    assert repeats([d for d in data if d[0] is not None], 50) == found & repeats([d for d in data if d[0] is not None], 50)
    assert found <= repeats([d for d in data if d[0] is not None], 30)
    assert all(r.kept_doc_id <= r.doc_id for r in rows if r.kind == "paragraph")
    kept = defaultdict(int)
    for r in rows:
        kept[r.component_id] += r.keep
    assert all(n >= 1 for n in kept.values())


def test_near_copies_of_paragraphs_against_brute_force(documents):
    pick = random.Random(9)
    lines = []
    for _ in range(12):
        base = text(pick, 90)
        lines.append(base)
        for _ in range(pick.choice([0, 3, 60])):
            copy = list(base)
            for at in pick.sample(range(90), pick.choice([1, 2, 3])):
                copy[at] = f"x{pick.randrange(9_999)}"
            lines.append(copy)
    docs = documents([(i, " ".join(line) + "\nshort line") for i, line in enumerate(lines)])
    rows = docs.select("doc_id", F.encode(F.lower("text"), "UTF-8").alias("text"))
    links = similar_paragraphs(rows, _paragraphs(rows, bands_for()))
    classes = dict(connected_components(links).collect())
    ids = {r.doc_id: r.pid for r in _paragraphs(rows, 1).collect()}
    sets = [set(map(tuple, zip(*(line[k:] for k in range(5))))) for line in lines]
    least = {i: i for i in range(len(lines))}
    changed = True
    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    groups = defaultdict(set)
    for i, pid in ids.items():
        groups[classes.get(pid, pid)].add(i)
    plain = defaultdict(set)
    for i, low in least.items():
        plain[low].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))
    assert links.count() < len(near)


def test_repeated_rows_empty_tables_and_clashing_columns(documents):
    assert repeated_passages(documents([])).count() == 0
    line = " ".join(f"v{i}" for i in range(60))
    docs = documents([(1, line), (1, line), (2, line.upper())]).withColumns({"kind": F.lit(1), "start": F.lit("x"), "keep": F.lit("y")})
    rows = repeated_passages(docs).collect()
    assert {(r.doc_id, r.kind, r.keep) for r in rows} == {(1, "paragraph", True), (2, "paragraph", False), (1, "stretch", True), (2, "stretch", False)}


def test_an_earlier_document_with_part_of_a_passage_hides_nothing(documents):
    pick = random.Random(11)
    for held in (20, 35):  # words of the passage's middle that the earlier document has
        passage = text(pick, 55)
        at = (55 - held) // 2
        data = [(1, text(pick, 40) + passage[at : at + held] + text(pick, 40)), *((i, text(pick, 30) + passage + text(pick, 30)) for i in (5, 9))]
        rows = repeated_passages(documents([(i, " ".join(words)) for i, words in data])).collect()
        assert {5, 9} <= {r.doc_id for r in rows} and len({r.component_id for r in rows}) == 1, held
        words = {(d, k): {w for r in rows if r.doc_id == d and r.keep == k for w in range(r.start, r.start + r.n_words)} for d in (5, 9) for k in (True, False)}
        assert not words[9, True] and len(words[9, False]) >= 30 and words[5, True], held
        assert held > 30 or words[5, True] == words[9, False], held
