import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trapline.llm.pii import detect, estimate, redact, span_text

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(t - 9 * (t > 9) for t in twice) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


TEXTS = [
    None, "", "plain", "a@b.c", "x.y+z@mail.example.com. next", "a@b..c d@e.f", "a@b.c_d@e.f", "a@b.c.@d.e", "@a.b", "é😀 me@home.org",
    "a@b@c.d", "..@a.b.c..d@e.f", "1.2.3.4", "256.1.1.1 0255.01.1.1 1.2.3.4.5.6.7.8", "1.2.3 1.2.3.4.", "9.99999999999999999999.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111 1111", "41111111111111111111111", "x4111111111111111y",
    "4111 1111 1111 1112 and 4111-1111 1111-1111", "4111111111111111 4111111111111111", "- 4111111111111111 -", "+1 (555) 010-9999",
    "+12 +1234567 +12345678) +123456789012345 +1234567890123456", "+1 555 010 9999.", "++1 555 0109999", "mark  a@b.c ",
    'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "call 415-555-2671 or (415) 555-2672", "card number 4111 1111 1111 1112",
    "1 " * 30_000, "a" * 200_000, "a@" + "b." * 30_000, "1." * 50_000, "+" * 50_000, "9" * 100_000, "(" * 50_000, "a.b@c.d " * 3_000,
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").repartition(4)
    spans, classifier = detect(docs)
    rows = {r.doc_id: r for r in spans.select("doc_id", span_text(F.col("base")).alias("base"), span_text(F.col("spans")).alias("spans")).collect()}
    return docs, rows, classifier


@pytest.mark.parametrize("number", range(len(TEXTS)))
def test_base_spans_by_the_letter(found, number):
    row, expected = found[1][number], ",".join(base_spans(TEXTS[number]))
    assert hashlib.sha256(row.base.encode()).hexdigest() == hashlib.sha256(expected.encode()).hexdigest()
    assert row.spans.startswith(expected)


def test_added_spans_leave_base_spans_alone(found):
    for number, row in found[1].items():
        base = [tuple(map(int, s.split(":")[1:])) for s in row.base.split(",") if s]
        for span in row.spans.removeprefix(row.base).strip(",").split(","):
            if span:
                kind, start, end = span.split(":")
                assert kind in ("account", "dial", "secret") and not any(s < int(end) and int(start) < e for s, e in base)
    assert "secret:9:49" in found[1][TEXTS.index('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"')].spans


def test_redaction_takes_what_was_found_and_nothing_else(found):
    docs, rows, _ = found
    changed = {r.doc_id: r.text for r in redact(docs).collect()}
    for number, text in enumerate(TEXTS):
        expected, at = [], 0
        for start, _, kind, end in sorted((int(a), -int(b), k, int(b)) for k, a, b in (s.split(":") for s in rows[number].spans.split(",") if s)):
            if start >= at:
                expected += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        assert changed[number] == (text if not expected else "".join(expected) + text[at:])
    assert changed[TEXTS.index("a@b.c")] == "<EMAIL>" and changed[TEXTS.index("+1 555 010 9999.")] == "<PHONE>."
    assert changed[TEXTS.index("- 4111111111111111 -")] == "- <CARD> -"


def test_estimation_finds_the_reliable_labelers():
    patterns = [((1, 1, 1, 1, 1), 30), ((1, 1, 0, 1, 1), 60), ((1, 1, 0, -1, 1), 20), ((-1, -1, 0, 1, -1), 70), ((-1, -1, -1, -1, 1), 50), ((-1, -1, 0, 1, 1), 40)]
    truth = dict(zip([p for p, _ in patterns], estimate("account", patterns)))
    assert min(truth[1, 1, 0, 1, 1], truth[1, 1, 0, -1, 1]) > 0.9 and max(truth[-1, -1, 0, 1, -1], truth[-1, -1, 0, 1, 1]) < 0.1
    assert estimate("account", []) == []


def test_planted_and_decoy_spans(spark):
    pick = random.Random(11)
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    failing = lambda: next(d for d in iter(lambda: digits(16), "") if not luhn(d))
    passing = lambda n: next(d for d in iter(lambda: digits(n), "") if luhn(d))
    hexes = lambda n: "".join(pick.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    planted = {
        "account": lambda: f"paid to account {passing(15)}", "dial": lambda: f"call {pick.randrange(201, 999)}-{pick.randrange(201, 999)}-{digits(4)}",
        "secret": lambda: f'token = "{hexes(40)}"',
    }
    decoys = [
        lambda: f"the number {failing()} in prose", lambda: f"order {digits(14)}", lambda: f"isbn {digits(13)}", lambda: f"{failing()} {failing()}",
        lambda: f"rows {pick.randrange(100, 199)}-{pick.randrange(100, 199)}-{digits(4)}", lambda: "version_of_a_long_name_1_of_many_parts",
    ]
    data, truth = [], {}
    for i in range(400):
        kind = pick.choice([None, None, *planted])
        data.append((i, "some words " + (planted[kind]() if kind else pick.choice(decoys)()) + " and more of them"))
        truth[i] = kind
    spans, _ = detect(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4))
    got = {r.doc_id: {s.kind for s in r.spans} - set(PATTERNS) for r in spans.collect()}
    right = sum(truth[i] in got[i] for i in truth if truth[i])
    wrong = sum(bool(got[i]) for i in truth if not truth[i])
    assert right >= 0.97 * sum(t is not None for t in truth.values())
    assert wrong == 0


def test_clean_numbers_of_the_given_documents_are_left_alone(small_documents):
    spans, _ = detect(small_documents)
    for row in spans.join(small_documents, "doc_id").select("text", "spans").collect():
        for s in row.spans:
            if s.kind == "account":
                assert luhn(re.sub("[^0-9]", "", row.text[s.start : s.end]))


def test_empty_tables_repeated_rows_and_clashing_columns(documents):
    spans, classifier = detect(documents([]))
    assert spans.count() == 0 and classifier.bias == {}
    docs = documents([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")]).withColumns({"base": F.lit("x"), "spans": F.lit("y"), "candidates": F.lit(1)})
    spans, classifier = detect(docs)
    assert sorted((r.doc_id or 0, len(r.base)) for r in spans.collect()) == [(0, 1), (1, 1), (1, 1)]
    assert [(r.text, r.base) for r in redact(docs).collect()] == [("<EMAIL>", "x")] * 3


def test_plan_is_native(small_documents):
    from trapline.llm.pii import find_candidates

    for df in (find_candidates(small_documents), redact(small_documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Exchange"))
