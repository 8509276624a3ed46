from pyspark.sql import functions as F

from trapline.llm.decontaminate import contaminated

ITEM = "A train leaves the old station at 9 with Anna on board, and after 120 km the driver tells Anna that the next stop is far away."
OTHER = "Which of the following rivers flows through the largest number of countries on its way to the sea?"


def run(spark, documents, docs, items, **options):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r.doc_id, r.item_id, r.coverage) for r in contaminated(documents(docs), benchmark, **options).collect())


def test_copies_new_parameters_and_clean_texts(spark, documents):
    docs = [
        (1, f"Before it. {ITEM} And after it."),
        (2, ITEM.replace("Anna", "Berta").replace("120 km", "75 miles").replace("at 9", "at 11")),
        (3, ITEM.replace("Anna that", "Clara that")),  # two names for one slot
        (4, ITEM.upper().replace(",", "!!")),
        (5, "Anna drove 120 km, and the driver was far away from the next stop at 9."),
        (6, " | ".join(OTHER.split())),
        (7, "words " * 30_000 + OTHER), (8, None), (9, ""), (None, ITEM), (1, f"Before it. {ITEM} And after it."), (10, OTHER[:30]),
    ]
    found = {(d, i) for d, i, _ in run(spark, documents, docs, [(1, ITEM), (2, OTHER), (3, None), (4, ""), (None, OTHER), (5, "a b c")])}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 2), (7, 2)}


def test_copies_in_other_capitals_and_with_one_value_changed(spark, documents):
    sums = "Compute 12 + 34 + 56 + 78 + 90 - 11 and give it as a number."
    docs = [
        (1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM.title()), (4, ITEM.replace("Anna", "Berta", 1)), (5, ITEM.replace("120", "75")),
        (6, sums), (7, "He paid 3, 5 and give it back as a favour."), (8, sums.replace("12", "13").replace("56", "57")),
        (9, " ".join(w for i, w in enumerate(ITEM.split()) if i % 3)),
    ]
    assert {(d, i) for d, i, _ in run(spark, documents, docs, [(1, ITEM), (2, sums)])} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2)}


def test_only_windows_with_the_clash_are_taken_off(spark, documents):
    coverage = {d: c for d, _, c in run(spark, documents, [(1, ITEM), (2, ITEM.replace("Anna", "Berta", 1))], [(1, ITEM)])}
    words = len(ITEM.replace(",", "").replace(".", "").split())
    assert coverage == {1: 1.0, 2: round((words - 4 - 5) / (words - 4), 6)}


def test_placeholders_alone_match_nothing(spark, documents):
    numbers = " ".join(str(i) for i in range(100))
    assert run(spark, documents, [(1, numbers), (2, "1 2 3 4 5 6 7")], [(1, "9 8 7 6 5 4 3 2 1 0")]) == []


def test_shuffled_windows_give_the_same(spark, small_dir, small_documents, monkeypatch):
    from trapline.llm import decontaminate

    benchmark = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    once = sorted(contaminated(small_documents, benchmark).collect())
    monkeypatch.setattr(decontaminate, "MAX_WINDOW_BYTES", 0)
    assert sorted(contaminated(small_documents, benchmark).collect()) == once != []


def test_empty_tables_and_extra_columns(spark, documents):
    assert run(spark, documents, [], [(1, ITEM)]) == run(spark, documents, [(1, ITEM)], []) == []
    docs = documents([(1, ITEM)]).withColumns({"item_id": F.lit("x"), "marked": F.lit("y"), "place": F.lit(0)})
    benchmark = spark.createDataFrame([(7, ITEM, "z")], "item_id bigint, text string, doc_id string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()] == [(1, 7)]


def test_plan_is_native(spark, small_dir, small_documents):
    plan = contaminated(small_documents, spark.read.parquet(f"{small_dir}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
