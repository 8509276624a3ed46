import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Documents from (id, text) or (id, text, lang, source), over several partitions."""

    def make(data, partitions=3):
        full = [(d[0], d[1], d[2] if len(d) > 2 else "en", d[3] if len(d) > 3 else "s", len(d[1] or "")) for d in data]
        return spark.createDataFrame(full, DOCUMENT).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def small_documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")
