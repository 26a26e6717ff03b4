import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from braidwork.llm import token_counts

TEXTS = ["", None, "a", "Hello  world\n\n x", "naïve — ½ 😀", "<s> </s> <unk> [INST]", " lead and trail ", "same text", "same text", "word " * 20_000, "▁a▁▁b", "\t\x00\r"]


def test_equals_library(docs_of):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs_of(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert (rows[i].n_bytes, rows[i].n_tokens) == (len((t or "").encode()), len(model.encode(t or "")))


def test_json_tokenizer(docs_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of(TEXTS), tokenizer=path).collect()}
    assert rows == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_only_distinct_misses_are_encoded(spark, docs_of, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.count_tokens(docs_of(["one", "two", "two"]), cache=cache).collect()
    assert spark.read.parquet(cache).count() == 2
    again = token_counts.count_tokens(docs_of(["two", "three", "three", None]), cache=cache)
    assert again.count() == 4 and spark.read.parquet(cache).count() == 4
    token_counts.count_tokens(docs_of(["one"]), cache=cache, tokenizer=public_tokenizers.path("word_bpe_49k.json")).collect()
    assert spark.read.parquet(cache).count() == 5


def test_stored_counts_are_used(spark, docs_of, tmp_path):
    cache = str(tmp_path / "cache")
    version = token_counts.tokenizer_digest(public_tokenizers.path(token_counts.TOKENIZER))
    spark.createDataFrame([("x",)], "t string").select(F.unhex(F.sha2("t", 256)), F.lit(version), F.lit(77).cast("long")).toDF("content", "tokenizer", "n_tokens").write.parquet(cache)
    assert token_counts.count_tokens(docs_of(["x"]), cache=cache).first().n_tokens == 77


def test_empty_table(docs_of):
    assert token_counts.count_tokens(docs_of([])).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_digest_tells_files_apart(name):
    assert len(token_counts.tokenizer_digest(public_tokenizers.path(name))) == 64


def test_query_finds_what_it_stored(spark, tmp_path, monkeypatch):
    """The second delivery's anti-join leaves only digests that the first one had not stored."""
    docs = spark.createDataFrame([(i, f"text {i % 40}", "en", "s", 1) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, plain = [], token_counts.store
    monkeypatch.setattr(token_counts, "store", lambda own, cache, tokenizer=None: (plain(own, cache, tokenizer), seen.append(spark.read.parquet(cache).count())))
    rows = token_counts.op4_tokens(spark, str(tmp_path)).collect()
    assert len(rows) == 90 and 0 < seen[0] < seen[1] == 40


def test_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None)], "`a.b` int, text string, content int, _text string")
    rows = token_counts.count_tokens(docs, ("a.b", "content", "_text")).collect()
    assert sorted((r["a.b"] or 0, r.n_bytes, r._text or "") for r in rows) == [(0, 0, ""), (1, 3, "x"), (1, 3, "x")]
