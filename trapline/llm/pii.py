"""Personal data in text: weak labelers, expectation-maximisation and a span classifier.

Emails, IP addresses, cards and phone numbers that pass their checks are always found. Further candidates (numbers like accounts,
numbers like local phones, strings like credentials) are voted on by five labelers: a strict pattern, a gazetteer of
cue words or issuers, the words before, the shape of the characters, and a checksum. The votes are counted; from the counts
expectation-maximisation estimates how far each labeler can be trusted. Some patterns of votes are anchors that it
does not move: a cue word right before the candidate speaks for it, a word such as "order" or "isbn" against it, and so does a failed
checksum without any cue. On the soft labels a logistic classifier is trained, which does not see the votes but what the span looks like and
what stands before it. All text work is SQL expressions; only counts per votes and features, whose number has a bound, reach the driver.

Texts are split at their matches by marks from the private use area. Where a text holds such characters itself, they are read as
U+FFFD, which no pattern matches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.session import settle

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "dial", "secret")
LABELERS = ("strict", "gazetteer", "context", "shape", "checksum")
FEATURES = ("length", "form", "start", "word", "check")  # small whole numbers that describe a candidate to the classifier
THRESHOLD = 0.5
_CONTEXT = 24  # characters before a candidate that the labelers look at
_BLOCK = 128  # matches whose places are summed up in one go
_OPEN, _CLOSE, _DOT, _SPACE, _DASH = map(chr, range(0xE000, 0xE005))
_MARKS = _OPEN + _CLOSE + _DOT + _SPACE + _DASH

# Patterns over the text as _masked leaves it. A run is tried from its beginning or from the end of the match before only, and
# no group repeats without bound, so that time and stack stay in proportion to the text.
_LOCAL = f"A-Za-z0-9._%+{_DOT}-"
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9][0-9 -]++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "dial": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

# Gazetteers: words before a candidate that speak for it or against it, and first digits of payment numbers.
_SECRET_WORDS = "token|secret|password|passwd|pwd|apikey|api_key|access_key|private_key|bearer|credential|auth"
_CUES = {
    "account": "card|account|acct|iban|visa|mastercard|amex|payment|bank|konto|karte|carte|compte|tarjeta|cuenta",
    "dial": "phone|tel|call|fax|mobile|cell|contact|telefon|handy|rufen|appel|llam",
    "secret": _SECRET_WORDS,
}
_AGAINST = "isbn|issn|order|invoice|version|page|serial|item|sku|commit|sha|md5|uuid|checksum"
_ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"


def _readable(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _MARKS, chr(0xFFFD) * len(_MARKS))


def _masked(kind: str, text: Column) -> Column:
    """Text as the pattern of a kind expects it; every character keeps its place."""
    if kind == "email":  # dots that no domain can hold
        return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", _DOT)).otherwise(F.lit(""))
    if kind == "card":  # separators that do not stand alone between two digits
        spaces = F.regexp_replace(text, "(?<![0-9]) | (?![0-9])", _SPACE)
        both = F.regexp_replace(spaces, "(?<![0-9])-|-(?![0-9])", _DASH)
        return F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), both).otherwise(F.lit(""))
    return text


def _unmasked(text: Column) -> Column:
    return F.translate(text, _DOT + _SPACE + _DASH, ". -")


def _pieces(kind: str, text: Column) -> Column:
    """Text cut at the matches of a kind: text, match, text, match, …, text."""
    marked = F.regexp_replace(_masked(kind, text), _PATTERNS[kind], f"{_OPEN}$0{_CLOSE}")
    return F.split(marked, f"[{_OPEN}{_CLOSE}]")


_SPAN = "struct<start:int,end:int,value:string,before:string>"


def _spans(pieces: str) -> Column:
    """Start, end (exclusive) in code points, text and the words before of every match in a column of pieces."""
    gap, match = f"{pieces}[2 * k]", f"{pieces}[2 * k + 1]"
    span = f"""named_struct('start', s.at + length({gap}), 'end', s.at + length({gap}) + length({match}),
        'value', {match}, 'before', right({gap}, {_CONTEXT}))"""
    empty = f"cast(array() as array<{_SPAN}>)"
    block = f"""aggregate(sequence(c * {_BLOCK}, least(c * {_BLOCK} + {_BLOCK}, size({pieces}) div 2) - 1),
        named_struct('at', acc.at, 'out', {empty}),
        (s, k) -> named_struct('at', s.at + length({gap}) + length({match}), 'out', concat(s.out, array({span}))))"""
    return F.expr(f"""case when size({pieces}) < 3 then {empty} else aggregate(
        sequence(0, (size({pieces}) div 2 - 1) div {_BLOCK}), named_struct('at', 0, 'out', {empty}),
        (acc, c) -> transform(array({block}), b -> named_struct('at', b.at, 'out', concat(acc.out, b.out)))[0]).out end""")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(turned, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """Checks that a match of a base kind must pass."""
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _may_be(kind: str, value: Column) -> Column:
    """Matches that are candidates of an added kind."""
    if kind == "account":
        return F.length(_digits(value)).between(13, 19) & ~_passes("card", value)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, value: Column, before: Column) -> Column:
    """Votes of the four labelers, each 1, 0 or -1."""
    digits, cue = _digits(value), F.lower(before)
    never = F.lit(False)
    if kind == "account":
        strict = _vote(F.length(digits).isin(15, 16), F.length(digits) < 13)
        gazetteer = _vote(digits.rlike(_ISSUERS), ~digits.rlike("^[2-6]"))
    elif kind == "dial":
        strict = _vote(digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[01]"))
        gazetteer = _vote(digits.rlike("^(?:800|888|877|866|555)"), never)
    else:
        strict = _vote(value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})$"), ~value.rlike("[0-9].*[0-9].*[0-9]"))
        gazetteer = _vote(cue.rlike(f"(?:{_SECRET_WORDS})"), never)
    context = _vote(cue.rlike(f"(?:{_CUES[kind]})[^a-z]*$"), cue.rlike(f"(?:{_AGAINST})[^a-z]*$"))
    shape = _vote(F.size(F.array_distinct(F.split(F.lower(value), ""))) >= 8, value.rlike(r"(.)\1{5}"))
    checksum = _vote(_luhn(digits), ~_luhn(digits)) if kind == "account" else F.lit(0)
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(LABELERS, (strict, gazetteer, context, shape, checksum))])


def _features(kind: str, value: Column, before: Column) -> Column:
    """What the classifier sees of a candidate, each feature one of at most twenty numbers."""
    digits, cue = _digits(value), F.lower(before)
    word = (
        F.when(cue.rlike(f"(?:{_CUES[kind]})[^a-z]*$"), 1).when(cue.rlike(f"(?:{_AGAINST})[^a-z]*$"), 2)
        .when(cue.rlike(f"(?:{_CUES[kind]})"), 3).when(cue.rlike(r"\+[0-9]{1,3} ?$"), 4).when(cue.rlike("[0-9]$"), 5).otherwise(0)
    )
    if kind == "secret":
        size = F.length(value)
        length = F.when(size < 32, 0).when(size == 32, 1).when(size < 40, 2).when(size == 40, 3).when(size < 64, 4).when(size == 64, 5).otherwise(6)
        form = F.when(value.rlike("^[0-9a-f]+$"), 0).when(value.rlike("^[0-9A-Z]+$"), 1).when(value.rlike("^[A-Za-z0-9]+$"), 2).otherwise(3)
        check = F.least(F.length(digits), F.lit(12))
    else:
        length = F.least(F.length(digits), F.lit(19))
        form = F.when(value.contains("-"), 1).when(value.contains(" "), 2).when(value.contains("("), 3).when(value.contains("."), 4).otherwise(0)
        check = _luhn(digits).cast("int") if kind == "account" else value.rlike("[2-9][0-9]{2}[ .-][0-9]{4}$").cast("int")
    start = F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(10))
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(FEATURES, (length, form, start, word, check))])


_FOUND_IN = {"account": "card", "dial": "dial", "secret": "secret"}


def find_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (spans that pass) and ``candidates`` (further spans and their votes) instead of the text."""
    own = [c for c in docs.columns if c != text]
    rows = docs.select(*own, _readable(F.col(text)).alias("__text"))
    rows = rows.select(*own, *[_pieces(k, F.col("__text")).alias(f"__{k}") for k in _PATTERNS])
    rows = rows.select(*own, *[_spans(f"__{k}").alias(f"__{k}") for k in _PATTERNS])

    def place(kind: str, span: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"))

    def passing(kind: str) -> Column:
        return F.transform(F.filter(f"__{kind}", lambda s: _passes(kind, s["value"])), lambda s: place(kind, s))

    def voted(kind: str) -> Column:
        possible = F.filter(f"__{_FOUND_IN[kind]}", lambda s: _may_be(kind, s["value"]))
        return F.transform(
            possible,
            lambda s: F.struct(
                place(kind, s).alias("span"), _votes(kind, s["value"], s["before"]).alias("votes"),
                _features(kind, s["value"], s["before"]).alias("features"),
            ),
        )

    base = F.concat(*[passing(k) for k in BASE_KINDS])
    added = F.concat(*[voted(k) for k in ADDED_KINDS])
    rows = rows.select(*own, base.alias("base"), added.alias("candidates"))
    apart = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["span"]["end"]) & (c["span"]["start"] < b["end"])))
    return rows.withColumn("candidates", apart)


@dataclass(frozen=True)
class SpanClassifier:
    """Weights of a logistic classifier: a bias per kind, and a weight per kind, feature and value."""

    bias: dict[str, float]
    weights: dict[tuple[str, str, int], float]

    def accepts(self, kind: Column, features: Column) -> Column:
        """Whether a candidate is taken for personal data. Values not seen in training weigh nothing; a kind not seen is not accepted."""
        score = F.lit(None).cast("double")
        for name in self.bias:
            own = F.lit(self.bias[name])
            for feature in FEATURES:
                known = [(value, w) for (k, f, value), w in sorted(self.weights.items()) if (k, f) == (name, feature)]
                weight = F.lit(0.0)
                for value, w in known:
                    weight = F.when(features[feature] == value, w).otherwise(weight)
                own = own + weight
            score = F.when(kind == name, own).otherwise(score)
        return F.coalesce(score >= math.log(THRESHOLD / (1 - THRESHOLD)), F.lit(False))


def anchor(kind: str, votes: tuple[int, ...]) -> float | None:
    """Probability that a pattern of votes is given from the start, if it is."""
    cast = dict(zip(LABELERS, votes))
    if cast["context"]:
        return 0.97 if cast["context"] > 0 else 0.03
    if kind == "secret" and (cast["gazetteer"] > 0 or cast["strict"] < 0):
        return 0.97 if cast["gazetteer"] > 0 else 0.03
    if cast["checksum"] < 0 or kind == "dial" and cast["strict"] < 0:
        return 0.03
    return None


def estimate(kind: str, patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """Probability of each pattern of votes to be personal data, by expectation-maximisation.

    A labeler is described by how often it votes 1, 0, -1 on true and on false spans. Anchors keep their probability; the others start
    even. Neither class can die out, as two spans of one vote throughout are added, one true and one false.
    """
    sure = [(((1,) * len(LABELERS)), 1, 1.0), (((-1,) * len(LABELERS)), 1, 0.0)]
    rows = [(votes, n, anchor(kind, votes)) for votes, n in patterns] + sure
    truth = [0.5 if fixed is None else fixed for _, _, fixed in rows]
    for _ in range(rounds):
        total = sum(n for _, n, _ in rows)
        prior = (sum(n * p for (_, n, _), p in zip(rows, truth)) + 1) / (total + 2)
        rates = []
        for at in range(len(LABELERS)):
            seen = {
                (y, v): 1.0 + sum(n * (p if y else 1 - p) for (votes, n, _), p in zip(rows, truth) if votes[at] == v)
                for y in (0, 1) for v in (-1, 0, 1)
            }
            rates.append({(y, v): seen[y, v] / sum(seen[y, u] for u in (-1, 0, 1)) for y, v in seen})
        for place, (votes, _, fixed) in enumerate(rows):
            if fixed is None:
                odds = math.log(prior / (1 - prior)) + sum(math.log(r[1, v] / r[0, v]) for r, v in zip(rates, votes))
                truth[place] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return truth[: len(patterns)]


def _train(examples: list[tuple[tuple[int, ...], float, float]], rounds: int = 300) -> tuple[float, dict[tuple[str, int], float]]:
    """Bias and weights from features, soft labels and counts, by gradient descent on one weight per feature and value."""
    total = sum(n for _, _, n in examples)
    bias, weights = 0.0, {(f, v): 0.0 for x, _, _ in examples for f, v in zip(FEATURES, x)}
    for _ in range(rounds):
        slope, slopes = 0.0, {key: -0.001 * w for key, w in weights.items()}
        for x, p, n in examples:
            keys = list(zip(FEATURES, x))
            score = bias + sum(weights[k] for k in keys)
            step = n / total * (p - 1 / (1 + math.exp(-max(-50.0, min(50.0, score)))))
            slope += step
            for k in keys:
                slopes[k] += step
        bias += slope
        for k, g in slopes.items():
            weights[k] += 2.0 * g
    return round(bias, 6), {k: round(w, 6) for k, w in weights.items()}


def fit(found: DataFrame) -> SpanClassifier:
    """Classifier of the candidates in ``found``, the result of ``find_candidates`` over a corpus.

    Every candidate of the corpus is counted. A kind without candidates has no weights, and none of it is accepted.
    """
    keys = ["c.span.kind", *[f"c.votes.{n}" for n in LABELERS], *[f"c.features.{n}" for n in FEATURES]]
    counted = found.select(F.explode("candidates").alias("c")).groupBy(*keys).count().collect()
    bias, weights = {}, {}
    for kind in ADDED_KINDS:
        rows = sorted((tuple(r[n] for n in LABELERS), tuple(r[n] for n in FEATURES), r["count"]) for r in counted if r["kind"] == kind)
        if not rows:
            continue
        votes = sorted({v for v, _, _ in rows})
        truth = dict(zip(votes, estimate(kind, [(v, sum(n for w, _, n in rows if w == v)) for v in votes])))
        bias[kind], own = _train([(x, truth[v], n) for v, x, n in rows])
        weights |= {(kind, *key): w for key, w in own.items()}
    return SpanClassifier(bias, weights)


def spans_of(found: DataFrame, classifier: SpanClassifier) -> DataFrame:
    """``found`` with ``spans``: the base spans, then the accepted candidates, by kind and start."""
    taken = F.filter("candidates", lambda c: classifier.accepts(c["span"]["kind"], c["features"]))
    return found.withColumn("spans", F.concat("base", F.transform(taken, lambda c: c["span"])))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, SpanClassifier]:
    """``doc_id``, ``base`` and ``spans`` (kind, start, end) of every row of ``docs``, and the classifier learned from them.

    A missing text is empty. Every row is judged by itself; rows with equal id or text each come back.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = settle(find_candidates(rows))
    classifier = fit(found)
    return spans_of(found, classifier).select("doc_id", "base", "spans"), classifier


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


# SQL: ``text`` with the spans ``cuts``, sorted by start, replaced by their kinds; a span that begins inside another goes with it.
# A block of spans is cut from the part of the text that it takes up, so that time stays in proportion to the text.
_REDACTED = f"""aggregate(sequence(0, (size(cuts) - 1) div {_BLOCK}), named_struct('at', 0, 'out', cast(array() as array<string>)),
  (acc, c) -> transform(array(slice(cuts, c * {_BLOCK} + 1, {_BLOCK})), part ->
    transform(array(substring(text, acc.at + 1, greatest(array_max(transform(part, s -> s.end)) - acc.at, 0))), piece ->
      aggregate(part, named_struct('at', acc.at, 'out', cast(array() as array<string>)),
        (a, s) -> if(s.start >= a.at,
          named_struct('at', s.end, 'out', concat(a.out, array(substring(piece, a.at - acc.at + 1, s.start - a.at), concat('<', upper(s.kind), '>')))),
          named_struct('at', greatest(a.at, s.end), 'out', a.out)),
        a -> named_struct('at', a.at, 'out', concat(acc.out, a.out))))[0])[0],
  acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"""


def _by_start(spans: Column) -> Column:
    """Spans by start, the longer first, then by kind."""
    return F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["end"].alias("end")))
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data that ``detect`` finds in them replaced by its kind in angle brackets.

    The spans are found once and stored with the rows; of spans that overlap, the first gives the kind, and all are replaced. A missing text stays missing, a text without personal data as it is.
    """
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in own]).alias("own"), F.col(text).cast("string").alias("text"))
    found = settle(find_candidates(rows.withColumn("kept", F.col("text"))))
    marked = spans_of(found, fit(found)).select("own", F.col("kept").alias("text"), _by_start(F.col("spans")).alias("cuts"))
    changed = marked.select("own", F.expr(f"if(size(cuts) > 0, {_REDACTED}, text)").alias("text"))
    return changed.select(*[F.col("text").alias(c) if c == text else F.col("own")[c].alias(c) for c in own])
