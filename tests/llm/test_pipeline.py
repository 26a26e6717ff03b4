import hashlib
import random

import corpus_pipeline
from braidwork.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, _doc string"


def prose(n, seed):
    words = random.Random(seed)
    return " ".join("".join(words.choices("etaoinshrdlu", k=words.randint(2, 9))) for _ in range(n)) + "."


def test_stages_on_planted_rows(spark, tmp_path):
    good = [prose(120, i) for i in range(12)]
    key = 'api_key = "' + "0123456789abcdef" * 2 + '"'
    rows = [(i, t, "en", f"s{i % 2 if i < 10 else 2}", len(t), i, "x") for i, t in enumerate(good)]
    rows += [
        (50, good[0], "en", "s0", None, 0, None),
        (51, good[1].upper(), "en", "s0", None, 0, None),
        (52, "### $$$ %%%\n" * 30, "en", "s0", None, 0, None),
        (53, None, None, None, None, None, None),
        (54, "too short", "en", "s1", 9, 0, ""),
        (55, prose(100, 99) + "\n" + key + "\n" + prose(50, 98), "en", "s1", 5, 0, ""),
        (None, prose(80, 97), "en", "s1", 5, 0, ""),
        (None, prose(80, 97), "en", "s1", 5, 0, ""),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        seen[name] = docs.collect()
    ids = lambda name: sorted((r.doc_id if r.doc_id is not None else -1) for r in seen[name])
    assert ids("quality") == [-1, -1, *range(12), 50, 51, 55]
    assert ids("near_duplicates") == ids("secrets") == [-1, *range(12), 55]
    texts = {r.doc_id: r for r in seen["secrets"]}
    assert key not in texts[55].text and "[SECRET]" in texts[55].text and texts[55].n_chars == len(texts[55].text)
    assert all(texts[i].text == good[i] and texts[i].row == i and texts[i]._doc == "x" for i in range(12))
    assert set(ids("mixing")) == set(ids("secrets")) and len(ids("mixing")) >= len(ids("secrets"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out) == ids("mixing")
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].text.encode()).hexdigest() and r.n_tokens == len(r.ids) > 0


def test_near_copies_when_cores_change(spark, tmp_path):
    """Rows keep their numbers though the table is cut up otherwise while the stage runs."""
    rows = [(i, prose(60, 7) if i % 20 == 0 else prose(60, 1000 + i), "en", "s", 1, i, None) for i in range(600)]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    out = []
    for bytes_ in ("8k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        out.append(corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)))
    ids = [sorted(r.doc_id for r in df.collect()) for df in out]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == [sorted({r[0] for r in rows if r[0] % 20 or r[0] == 0})] * 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
