import random

import corpus_pipeline
from pyspark.sql import functions as F
from trapline.session import settle

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_keep_the_columns_and_clean_documents(spark, small_dir, small_documents):
    docs, seen = small_documents, set(r.doc_id for r in small_documents.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        result = settle(stage(spark, docs, small_dir))
        ids = set(r.doc_id for r in result.select("doc_id").collect())
        assert ids <= seen and len(ids) > 0.8 * len(seen), name
        if name != "mixing":
            assert result.columns == docs.columns
        docs, seen = result, ids
    once = docs.filter("epoch = 0")
    assert once.count() == len(seen) and docs.columns[-3:] == ["text", "lang", "n_chars"]
    assert sorted(map(str, corpus_pipeline.run(spark, small_dir).collect())) == sorted(map(str, docs.collect()))


def test_decisions_take_effect(spark, tmp_path):
    pick = random.Random(3)
    words = {"en": "the and of cat house river stone with from they".split(), "de": "der und die Katze Haus Fluss Stein mit von sie".split()}
    data = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        data.append((i, " ".join(pick.choice(words[lang]) + str("abcdefgh"[pick.randrange(8)]) for _ in range(80)), lang, f"s{i % 4}", 0))
    item = "A stone bridge crosses the river near the village where seven old friends used to meet on Sundays"
    data += [
        (100, data[5][1], "en", "s1", 0), (101, data[5][1] + " end", "en", "s1", 0), (102, "12345 !!", None, "s1", 0), (103, None, None, None, 0),
        (104, data[6][1][:200] + " " + item + " " + data[7][1], "en", "s2", 0),
        (105, data[9][1][::-1] + " mail me@home.org now", None, None, 0), (None, data[10][1] + " no id", "en", "s1", 0),
    ]
    data += [data[20], data[20]]
    docs = spark.createDataFrame(data, DOCUMENT).withColumn("extra", F.lit("kept"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    first = [r for r in rows if r.epoch == 0]
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in first)
    assert ids == [-1, *range(60), 105]
    changed = next(r for r in first if r.doc_id == 105)
    assert "<EMAIL>" in changed.text and changed.n_chars == len(changed.text) and changed.lang in words and changed.extra == "kept"


def test_one_document_of_each_group_stays(spark, documents):
    a, b = ("one two three four five six seven eight nine ten " * 3 + end for end in ("alpha", "beta gamma delta epsilon zeta eta theta iota"))
    rows = [(3, b), (5, a), (5, b), (7, a), (9, "quite another text of its own"), (9, "quite another text of its own"), (None, a), (11, None), (12, "")]
    kept = corpus_pipeline.without_copies(spark, documents(rows), "")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == sorted([(0, a), (3, b), (5, a), (9, rows[4][1])])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
