import zlib

import numpy as np
from pyspark.sql import functions as F

from trapline.llm.langid import Letters, fit, held_out, identify, ngram_counts


def test_ngrams_are_words_between_single_spaces():
    codes, counts = ngram_counts("Ab,  aB!\n7")
    grams = {"".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)): n for c, n in zip(codes.tolist(), counts.tolist())}
    assert grams == {" ab": 2, "ab ": 2, "b a": 1}
    assert all(ngram_counts(t) is None for t in ("", " ", "123 !?", "🎉"))
    assert ngram_counts("中") is not None and ngram_counts("𝒜") is not None


def test_ngram_vectors_are_bound_rotated_letters():
    one, other = Letters(64), Letters(64)
    code = np.array([ord("a") << 42 | ord("b") << 21 | ord("c"), ord("c") << 42 | ord("b") << 21 | ord("a")])
    other.bind(code[::-1])  # the order of first use makes no difference
    assert (one.bind(code) == other.bind(code)).all() and set(np.unique(one.bind(code))) == {-1, 1}
    a, b, c = (one.bind(np.array([x << 42 | 32 << 21 | 32])) * one.bind(np.array([32 << 42 | 32 << 21 | 32])) for x in map(ord, "abc"))
    assert (one.bind(code)[0] != one.bind(code)[1]).any() and a.shape == b.shape == c.shape


def test_held_out_rows_are_recognised(small_documents):
    model = fit(small_documents)
    rows = identify(small_documents, model).select("doc_id", "lang", "lang_pred", "score", held_out().alias("held_out")).collect()
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    test = [r for r in rows if r.held_out]
    assert len(test) > 30 and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_the_frequent_ngrams_change_nothing(small_documents):
    model = fit(small_documents)
    texts = [r.text for r in small_documents.limit(20).collect()]
    names, scores = model.predict(texts)
    model.frequent, model._made = model.frequent[:7], None
    assert model.predict(texts)[0] == names and np.allclose(model.predict(texts)[1], scores, atol=1e-4)


def test_odd_rows(documents):
    data = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de")] * 20)]
    odd = [(100, None), (101, ""), (102, "12 34"), (103, "the " * 40_000), (104, "und die"), (None, "the mat"), (105, "the mat", None), (104, "und die")]
    docs = documents([*data, *odd]).withColumns({"lang_pred": F.lit("x"), "score": F.lit("y")})
    rows = identify(docs, fit(docs)).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == 48 and found[100] == found[101] == found[102] == ("und", 0.0)
    assert (found[103][0], found[104][0], found[None][0], found[105][0]) == ("en", "de", "en", "en")


def test_nothing_to_learn_from(documents):
    model = fit(documents([]))
    assert model.languages == [] and identify(documents([]), model).count() == 0
    unknown = documents([(1, "some text", None)])
    assert [r.lang_pred for r in identify(unknown, fit(unknown)).collect()] == ["und"]
