import public_tokenizers
import sentencepiece

from tallybook.llm.token_cache import open_cache, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_and_cache(spark, docs, odd_texts, tmp_path):
    pairs = [*odd_texts, (8, "<s> é ﬁ 👍🏽 </s>"), (9, "one")]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = docs(pairs).withColumnRenamed("lang", "n_tokens")
    cache = str(tmp_path / "cache")
    rows = token_counts(table, MODEL, cache).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in pairs]
    assert sorted(map(tuple, rows)) == sorted(want)

    # A second table with one new text appends one row; what is known is not encoded again.
    before = open_cache(spark, cache).count()
    assert before == len({t or "" for _, t in pairs})
    more = token_counts(docs([(1, "one"), (2, "new text")]), MODEL, cache).collect()
    assert {r.doc_id: r.n_tokens for r in more} == {1: len(model.encode("one")), 2: len(model.encode("new text"))}
    assert open_cache(spark, cache).count() == before + 1


def test_cached_count_is_taken(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts(docs([(1, "a b")]), MODEL, cache).count()
    open_cache(spark, cache).selectExpr("content", "tokenizer", "n_tokens + 100 as n_tokens").write.parquet(str(tmp_path / "other"))
    assert token_counts(docs([(1, "a b")]), MODEL, str(tmp_path / "other")).first().n_tokens > 100


def test_empty(docs, tmp_path):
    assert token_counts(docs([]), MODEL, str(tmp_path / "c")).count() == 0
