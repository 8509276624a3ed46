import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from trapline.llm.tokens import CACHE_SCHEMA, count_tokens  # noqa: E402

TEXTS = [
    None, "", " ", "\n\t \r", "Hello world", "hello   WORLD\n", "don't stop  2024!!", "<|endoftext|> inside<|startoftext|>it",
    "İstanbul ΑΣ Ας ſ", "a b c\x1cd\x85e", "é ́x", "한국어 テスト 中文", "🎉🎉 ok", "x" * 30_000, "word " * 20_000, "Hello world",
]


def expected_counts(file, texts):
    path = public_tokenizers.path(file)
    if file.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(list(texts), num_threads=1)]
    from tokenizers import Tokenizer

    return [len(e) for e in Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(documents, tmp_path, file):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)])
    rows = count_tokens(docs, f"{tmp_path}/cache", public_tokenizers.path(file)).collect()
    counts = expected_counts(file, [t or "" for t in TEXTS])
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len((t or "").encode()), n, n > 2048) for i, (t, n) in enumerate(zip(TEXTS, counts))
    }


def test_only_misses_are_encoded_and_appended(spark, documents, tmp_path, small_documents):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/cache"
    stored = spark.read.schema(CACHE_SCHEMA)
    first = count_tokens(small_documents, cache, path)
    texts = {r.doc_id: r.text for r in small_documents.collect()}
    counts = dict(zip(texts, expected_counts("word_bpe_49k.json", [t or "" for t in texts.values()])))
    assert {r.doc_id: r.n_tokens for r in first.collect()} == counts
    size = stored.parquet(cache).count()
    assert size <= len(set(texts.values()))
    again = count_tokens(small_documents, cache, path)
    assert {r.doc_id: r.n_tokens for r in again.collect()} == counts and stored.parquet(cache).count() == size
    count_tokens(documents([(1, "quite new"), (2, "quite  new"), (1, "quite new")]), cache, path).collect()
    assert stored.parquet(cache).count() == size + 1
    # Another tokenizer shares nothing.
    count_tokens(small_documents, cache, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert stored.parquet(cache).select("tokenizer").distinct().count() == 2


def test_empty_table_repeated_rows_and_clashing_columns(documents, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert count_tokens(documents([]), f"{tmp_path}/a", path).count() == 0
    docs = documents([(1, "a b"), (1, "a b"), (None, "a")]).withColumns({"content": F.lit(1), "n_tokens": F.lit("x")})
    rows = count_tokens(docs, f"{tmp_path}/b", path, limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in rows) == [(0, 1, False), (1, 2, True), (1, 2, True)]
