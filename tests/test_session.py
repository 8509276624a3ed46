import os

import pytest

from trapline.operators.levels import levels_of, with_level_colour
from trapline.session import release, settle, settle_by, shared_folder


def test_settled_rows_are_stored_once_and_released(spark):
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    stored = settle(spark.range(0, 50, 1, 4).mapInArrow(count, "id bigint"))
    assert sorted(r.id for r in stored.collect()) == list(range(50)) and stored.count() == 50
    assert counted.value == 50
    folder = f"{shared_folder(spark).removeprefix('file://')}/trapline-{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder)


def test_joins_on_rows_stored_by_key_do_not_move_them(spark):
    stored = settle_by(spark.range(0, 500, 1, 4).selectExpr("id", "repeat('x', 1000) as text"), "id")
    small = spark.range(0, 900, 3, 2).hint("shuffle_hash")
    joined = stored.join(small, "id")
    assert sorted(r.id for r in joined.collect()) == list(range(0, 500, 3))
    plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    folder = f"{shared_folder(spark).removeprefix('file://')}/trapline-{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder) and not spark.catalog.listTables()


def test_no_shared_folder_is_an_error():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_levels_and_colours_come_from_the_data(rows):
    df = rows([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")], "i int, kind string")
    assert dict(levels_of(df, "kind").collect()) == {"a": 1, "b": 2, "c": 3}
    coloured = with_level_colour(df, "kind", levels_of(df, "kind"), ["red", "blue"])
    assert {r.i: r.colour for r in coloured.collect()} == {1: "blue", 2: "red", 3: None, 4: "red", 5: "red"}
