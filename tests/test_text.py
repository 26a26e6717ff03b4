import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork import schemas
from braidwork.functions import text as T
from braidwork.operators import answer as A
from braidwork.operators import evaluate as V
from braidwork.operators import markdown as M
from braidwork.operators import retrieval as R
from braidwork.operators import transcripts as S
from braidwork.sources import files as X

NOTE = """# Clip [abcdefgh123]

- **Source video:** `clip.mp4`
- **Duration:** 1:05

## Transcript

**[0:00]** We go all
**[0:04]** the way. Next one.

**[1:00:05]** No end mark
**[1:02]**
"""


def test_clocks(spark):
    row = spark.range(1).select(T.seconds_of(F.lit("1:02")), T.seconds_of(F.lit("1:00:05")), T.clock_of(F.lit(62)), T.clock_of(F.lit(3605))).first()
    assert tuple(row) == (62, 3605, "1:02", "1:00:05")


def test_transcripts_parse_rejoin_and_write(spark):
    docs, segments = X.parse_transcripts(spark.createDataFrame([("clip.md", NOTE)], "name string, text string"))
    assert docs.first().source_file == "clip.mp4" and docs.first().duration_s == 65
    assert [(r.ts, r.text) for r in segments.orderBy("n").collect()] == [(0, "We go all"), (4, "the way. Next one."), (3605, "No end mark")]
    found = S.rejoin(segments, ["name"], "n").orderBy("n").collect()
    assert [(r.ts, r.sentence) for r in found] == [(0, "We go all the way."), (4, "Next one."), (3605, "No end mark")]
    written = X.transcript_text(docs.withColumn("language", F.lit("en")), segments)
    again = X.parse_transcripts(written)[1]
    assert [(r.ts, r.text) for r in again.orderBy("n").collect()] == [(r.ts, r.text) for r in segments.orderBy("n").collect()]


def test_sentences_split_at_decimals(spark):
    assert spark.range(1).select(T.sentences(F.lit("abc 3.5 def. rest"))).first()[0] == ["abc 3.", "5 def.", "rest"]


RULES = S.Rules(terms=("hips", "barrel"), phrases=("strike zone",), fillers=("nice", "good"), verbs=("keep", "don't"), banter=(r"\bblimey\b",))


@pytest.mark.parametrize("text, place, ts, want", [
    ("ab", 0.5, 500, "empty/too short"), ("[Music]", 0.5, 500, "music/sound marker"), ("yeah we go oh so long now", 0.05, 100, "music/lyrics"), ("yeah we go oh so long now", 0.5, 500, None),
    ("well blimey that was odd today", 0.5, 500, "non-instructional (lyric/banter)"), ("Hello there my good friends", 0.5, 500, "greeting"), ("Hello, turn the hips first", 0.5, 500, None), ("my name is known to you all", 0.5, 500, "self-introduction"),
    ("this is episode four of it all", 0.5, 500, "episode announcement"), ("stay tuned for more of these", 0.5, 500, "sign-off"), ("follow us on that one website", 0.5, 500, "promo/CTA"), ("Nice. Good.", 0.5, 500, "filler"),
    ("Jon Smith", 0.5, 500, "name/fragment"), ("Keep going", 0.5, 500, None), ("a plain sentence about something", 0.5, 500, None),
])
def test_classifier(spark, text, place, ts, want):
    assert spark.range(1).select(S.reason(F.lit(text), F.lit(place), F.lit(ts), F.lit(1000), RULES)).first()[0] == want


def test_chunks_of_a_budget():
    three = [(1, "a b c"), (2, "d e f"), (3, "g h i")]
    assert S.budgeted(three, 6, 3) == [(1, "a b c d e f"), (3, "d e f g h i")]
    assert S.budgeted([], 6, 3) == [] and S.budgeted([(5, "x " * 9)], 6, 3) == [(5, "x " * 9)]


def test_bm25_by_hand(spark):
    texts = ["the cat sat", "the dog sat on the cat", "birds fly"]
    index = R.bm25_index(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), "doc", "text")
    got = {(r.q, r.doc): r.score for r in R.bm25_scores(index, spark.createDataFrame([(1, "cat dog dog")], "q long, text string"), "q", "text", "doc").collect()}
    tokens = [t.split() for t in texts]
    df = Counter(w for t in tokens for w in set(t))
    raw = {w: math.log(3 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    mean = sum(map(len, tokens)) / 3
    want = {}
    for i, t in enumerate(tokens):
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ("cat", "dog", "dog") if w in t)
        if any(w in t for w in ("cat", "dog")):
            want[1, i] = s
    assert got == pytest.approx(want)


def test_fusion_by_hand(spark):
    vector = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "q long, d string, score double, rank int")
    keyword = spark.createDataFrame([(1, "b", 2.0, 1), (1, "c", 1.99, 2)], "q long, d string, score double, rank int")
    got = R.fused(vector, keyword, "q", "d", 5).orderBy("rank").collect()
    assert [(r.d, round(r.score, 6)) for r in got] == [("b", 0.021867), ("a", 0.016393)]


def test_vectors_and_parents(spark, tmp_path):
    rows = [("a", [1.0, 0.0], "p1"), ("b", [0.8, 0.6], "p1"), ("c", [0.0, 1.0], "p2"), ("d", [0.6, 0.8], None)]
    store = X.Vectors(spark, str(tmp_path / "v"))
    store.replace(spark.createDataFrame([(i, v, p, f"text {i}", f"parent {p}" if p else None) for i, v, p in rows], "id string, embedding array<double>, parent_id string, text string, parent_text string"))
    assert store.count() == 4 and store.get(spark.createDataFrame([("a",)], "id string")).count() == 1
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q long, v array<double>")
    hits = R.vector_topk(store.table(), asked, "q", "v", "id", "embedding", 4)
    assert [r.id for r in hits.orderBy("rank").collect()] == ["a", "b", "d", "c"]
    assert [r.id for r in R.vector_topk_blas(store.table(), asked, "q", "v", "id", "embedding", 2).orderBy("rank").collect()] == ["a", "b"]
    wide = R.expand_parents(hits, store.table(), "q", "id", 3).orderBy("rank").collect()
    assert [(r.id, r.text, r.child_text) for r in wide] == [("a", "parent p1", "text a"), ("d", "text d", "text d"), ("c", "parent p2", "text c")]
    assert R.best_score(hits.where("id = 'zz'"), asked, "q", none=-10.0).first().score == -10.0
    ranked = R.rerank(hits.join(store.table().select("id", "text"), "id").withColumn("question", F.lit("x")), "q", "id", "question", "text", 1, lambda q, d: [float(t.endswith("c")) for t in d])
    assert ranked.first().id == "c"


def test_measures_by_hand(spark):
    ranks = spark.createDataFrame([(1,), (2,), (None,), (4,)], "rank int")
    row = V.recall(ranks, 5).first()
    assert (row.recall_1, row.recall_3, row.recall_k, row.mrr) == (0.25, 0.5, 0.75, 0.4375)
    scores = lambda rows: spark.createDataFrame(rows, "id int, inside boolean, score double")
    s = V.separation(scores([(1, True, 0.8), (2, True, 0.6), (3, False, 0.4)])).first()
    assert (round(s.gap, 9), s.suggested_threshold) == (0.2, 0.5)
    assert V.separation(scores([(1, True, 0.3), (3, False, 0.4)])).first().suggested_threshold is None
    sweep = V.threshold_sweep(scores([(1, True, 0.5), (2, False, 0.5)])).orderBy("threshold").collect()
    assert (sweep[0].threshold, sweep[-1].threshold) == (0.5, 1.5)
    assert spark.range(1).select(V.source_matches(F.lit("The Hip Load"), F.array(F.lit("hip"), F.lit("zz")))).first()[0]
    assert V.behaviour(spark.createDataFrame([(True, True), (False, True)], "answered boolean, expected boolean")).first().accuracy == 0.5


POLICY = A.Policy()


@pytest.mark.parametrize("question, answer, want", [
    ("q", "short", A.SHORT), ("q", "see this [Angle | x @ 0:00] in the prose here", A.CITED), ("q", "a fine answer in prose\n\nSources:\n- one", A.CITED), ("q", "this cures everything that ails you", "banned claim: 'cures'"),
    ("explain my report", "Try the phone booth drill each day of it", A.DRILLED), ("q", "Try the phone booth drill each day of it", None), ("q", "i cannot answer. Setup of it\n## Setup", A.DRILLED), ("q", "A perfectly fine answer to it.", None),
])
def test_verdicts(spark, question, answer, want):
    assert spark.range(1).select(A.verdict(F.lit(answer), F.lit(question), POLICY)).first()[0] == want


def test_orchestration(spark):
    rows = [("good", 0.9), ("bad once", 0.9), ("always bad", 0.9), ("low", 0.1), ("about nutrition", 0.0)]
    questions = spark.createDataFrame(rows, "question string, score double").withColumn("context", F.lit("ctx")).withColumn("history", F.lit(None).cast("string"))

    def generate(prompts):
        return ["x" if "always bad" in p or ("bad once" in p and "rejected" not in p) else "a long enough fine answer [a | b]" for p in prompts]

    got = {r.question: (r.abstained, r.attempts, r.reason) for r in A.answered(questions, generate, A.Policy(threshold=0.4)).collect()}
    assert got == {"good": (False, 1, None), "bad once": (False, 2, None), "always bad": (True, 2, f"validation_failed: {A.SHORT}"), "low": (True, 0, "below_threshold"), "about nutrition": (False, 1, None)}
    with pytest.raises(ValueError):
        A.check_scale("vector", 3.0)
    with pytest.warns(UserWarning):
        A.check_scale("rerank", 0.5)


def test_history(spark):
    turns = spark.createDataFrame([("s", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(10)] + [("s", 10, "user", "  ")], schemas.TURNS)
    assert A.last_turns(turns).first().history.split("\n\n")[0] == "Coach: t3"
    assert A.blended(spark.createDataFrame([("s", "now?"), ("z", "alone?")], "session string, question string"), turns).orderBy("session").collect()[0].query == "t8 now?"


MARKDOWN = """---
tags:
- Drill work
- hips
---
# Title

Intro line one.

## What is load

Load is the move before the stride and it stores the energy that later moves release.

## Steps

Do this:

- first
- second

  more of second

***

| a | b |
|---|---|
| 1 | 2 |

> quoted words

## Empty

## Last

""" + " ".join(f"Sentence number {i} goes on for some words here." for i in range(60))


def _note(spark, *texts):
    return M.noted(spark.createDataFrame([(f"n{i}.md", t) for i, t in enumerate(texts)], "name string, text string"))


def test_front_matter(spark):
    got = {r.of.name: (r.of.tags, r.body) for r in _note(spark, MARKDOWN, "---\n# x\n---\n", "---\na: 1\n---\nx\n---\ny", "---\ntags: a\n- b\ntags: c\n---\n", "").collect()}
    assert got["n0.md"][0] == ["Drill work", "hips"] and got["n0.md"][1].startswith("# Title")
    assert got["n1.md"] == ([], "---\n# x\n---\n")
    assert got["n2.md"] == ([], "y")  # it reaches to the last line of dashes
    assert got["n3.md"] == ([], "")  # the last entry of a key counts, and has no items
    assert got["n4.md"] == ([], "")


def test_blocks_and_sections(spark):
    blocks = M.blocks(_note(spark, MARKDOWN))
    rows = blocks.orderBy("block").collect()
    assert [r.kind for r in rows] == ["heading", "para", "heading", "para", "heading", "para", "list", "para", "table", "quote", "heading", "heading", "para"]
    assert [r.text for r in rows if r.kind == "list"] == ["- first\n- second"]
    parts = M.sections(blocks)
    assert [tuple(p.title for p in r.path) for r in parts.orderBy("section").collect()] == [("Title",), ("Title", "What is load"), ("Title", "Steps"), ("Title", "Last")]
    one = M.glued(parts.where("section = 3"), ["_key", "section"]).orderBy("n").collect()  # no piece is finished before the next begins
    assert one[0].text.startswith("Do this:\n\n- first\n- second more of second\n\n| a | b |") and one[0].kind == "table"
    assert M.sections(M.blocks(_note(spark, "# Clip [abcdefgh12]\n\ntext."))).first().path == []
    up = M.sections(M.blocks(_note(spark, "# A\n\n### C\n\nx.\n\n## B\n\ny.\n\n# D\n\n- a\n\n  more\n\n\n- b"))).orderBy("section").collect()
    assert [[p.title for p in r.path] for r in up] == [["A", "C"], ["A", "B"], ["D"]]
    assert [(b.kind, b.text) for b in up[2].blocks] == [("list", "- a"), ("para", "more"), ("list", "- b")]


def test_short_neighbours_become_one(spark):
    text = "# T\n\n## A\n\n### x\n\none two.\n\n### y\n\nthree.\n\n## B\n\nfour.\n\n## What is C\n\na definition by itself, long enough to stand.\n\n## D\n\nfive."
    sizes = M.Sizes(child=(20, 30), atom=(5, 30))
    rows = M.coalesced(M.sections(M.blocks(_note(spark, text))), sizes).withColumn("body", M.body_of(F.col("blocks"))).orderBy("i").collect()
    assert [[p.title for p in r.path] for r in rows] == [["T"], ["T", "What is C"], ["T", "D"]]
    assert rows[0].body == "## A\n\n### x\n\none two.\n\n### y\n\nthree.\n\n## B\n\nfour."
    for r in rows:
        assert r.tokens == M.words_and_marks(r.body) and r.heads == [M.words_and_marks(p.line) for p in r.path]


def test_spread_goes_after_and_before_in_turn():
    rng = np.random.default_rng(5)
    for _ in range(200):
        rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(1, 40, (int(rng.integers(1, 12)), 2)))]
        sizes = M.Sizes(parent=(60, 110))
        size = lambda lo, hi: sum(r[1] for r in rows[lo : hi + 1]) + rows[lo][2]  # noqa: B023, E731
        # What a run begins with shrinks no more than the run grows, as with headings.
        rows = [(i, t, min(b, rows[i - 1][1] if i else b)) for i, t, b in rows]
        for _, at, lo, hi, n in M.spread(sizes)(("k",), [("k", *r) for r in rows]):
            a = b = at
            while size(a, b) < 60 and (a > 0 or b < len(rows) - 1):
                after = b < len(rows) - 1 and ((b - at) <= (at - a) or a == 0)
                wide = (a, b + 1) if after else (a - 1, b)
                if size(*wide) > 110:
                    break
                a, b = wide
            assert (lo, hi, n) == (a, b, size(a, b))


def test_markdown_chunks(spark):
    sizes = M.Sizes(child=(20, 60), hard=70, atom=(5, 30), parent=(80, 160), overlap=(5, 15))
    notes = spark.createDataFrame([("note.md", MARKDOWN), ("note.md", MARKDOWN), ("none.md", None), ("empty.md", ""), ("short.md", "Just one line."), (None, "# H\n\nBody.")], "name string, text string")
    rows = M.chunk_notes(notes, sizes=sizes).orderBy("id").collect()
    notes = [r for r in rows if r.source_title == "note"]
    assert [r.id for r in notes] == [f"note::{i:03d}" for i in range(len(notes))] and len(notes) > 5  # the repeated note counts once
    assert all(not re.match(M.LEAD, r.embedding_text.split("\n\n", 1)[1]) and "---" not in r.text.replace("|---|---|", "") for r in rows)
    assert {r.content_type for r in notes} == {"hitting drill"} and notes[0].tags == ["Drill work", "hips"]
    assert all(r.parent_tokens <= 160 + 20 for r in notes)
    assert all(r.token_count == M.words_and_marks(r.text) and r.parent_tokens == M.words_and_marks(r.parent_text) for r in rows)
    assert len({(r.parent_id, r.parent_text) for r in notes}) == len({r.parent_id for r in notes}) == len({r.parent_text for r in notes})
    short = [r for r in rows if r.source_title == "short"]
    assert len(short) == 1 and short[0].parent_text == "Just one line." and short[0].timestamp == "note"
    assert [r.text for r in rows if r.source_title == ""] == ["# H\n\nBody."]
    lint = {r.source_title: r for r in M.lint(spark.createDataFrame(rows, schemas.CHUNKS)).collect()}
    assert lint["note"].lead == lint["note"].rules == lint["note"].leaks == 0
    asked = M.chunk_notes(spark.createDataFrame([("note.md", MARKDOWN)], "name string, text string"), sizes=sizes, count=M.words_and_marks).orderBy("id").collect()
    assert [tuple(r) for r in asked] == [tuple(r) for r in notes]


def test_small_note_has_one_parent(spark):
    text = "## A\n\n" + "Words of a section go here. " * 12 + "\n\n## B\n\n" + "Other words are there now. " * 12
    rows = M.chunk_notes(spark.createDataFrame([("n.md", text)], "name string, text string")).collect()
    assert len({r.parent_id for r in rows}) == 1 and len(rows) >= 1
    assert M.chunk_notes(spark.createDataFrame([], "name string, text string")).count() == 0


def test_sources(spark, tmp_path):
    assert X.read_csv(spark, str(tmp_path / "none.csv"), schemas.BOXES).count() == 0
    (tmp_path / "head.csv").write_text("video,frame,bat_x1,bat_y1,bat_x2,bat_y2,bat_conf\n")
    (tmp_path / "cut.csv").write_text("video,fra\nx,1\n")
    (tmp_path / "rows.csv").write_text("video,frame,bat_x1,bat_y1,bat_x2,bat_y2,bat_conf\nv,1,0,0,1,1,0.5\nv,x,0,0,1,1,\n")
    assert X.is_complete(spark, str(tmp_path / "head.csv"), schemas.BOXES) and not X.is_complete(spark, str(tmp_path / "cut.csv"), schemas.BOXES)
    assert X.read_csv(spark, str(tmp_path / "cut.csv"), schemas.BOXES).count() == 0
    assert [(r.frame, r.bat_conf) for r in X.read_csv(spark, str(tmp_path / "rows.csv"), schemas.BOXES).collect()] == [(1, 0.5), (None, None)]
    golden = tmp_path / "g.jsonl"
    golden.write_text('{"_comment": "x"}\n\n{"id": "1", "type": "in_coverage", "q": "a", "expect_sources": ["s"]}\n{"id": "2", "type": "out_of_coverage", "q": "b"}\n')
    inside, outside = X.read_golden(spark, str(golden))
    assert inside.first().expect_sources == ["s"] and outside.first().id == "2"
    notes = tmp_path / "notes"
    notes.mkdir()
    for n in ("b.md", "a note.md", "_skip.md", "x.txt"):
        (notes / n).write_text("# t")
    assert [r.name for r in X.read_notes(spark, str(notes)).collect()] == ["a note.md", "b.md"]
    for n in ("B.MP4", "a.mov", "c.txt"):
        (notes / n).write_text("x")
    assert [r.name for r in X.media_files(spark, str(notes)).collect()] == ["a.mov", "B.MP4"]
    empty = tmp_path / "empty"
    X.write_csv(spark.createDataFrame([], schemas.BOXES), str(empty))
    assert X.is_complete(spark, str(empty), schemas.BOXES)


def test_pose_rows(spark):
    people = [(None, (0.0, 0.0, 1.0, 1.0), [(1.0, 2.0, 0.5), (3.0, 4.0, 0.6)]), (7, (0.0, 0.0, 2.0, 2.0), [(5.0, 6.0, 0.7)])]
    ddl = "video string, frame int, people array<struct<track_id: int, x1: double, y1: double, x2: double, y2: double, points: array<struct<x: double, y: double, confidence: double>>>>"
    df = spark.createDataFrame([("v", 0, [(t, *b, p) for t, b, p in people])], ddl)
    assert [(r.track_id, r.keypoint, r.x) for r in X.pose_rows(df).orderBy("track_id", "x").collect()] == [(0, "nose", 1.0), (0, "left_eye", 3.0), (7, "nose", 5.0)]


def test_blocks_of_queries_give_the_same(spark):
    rows = spark.createDataFrame([(i, [math.cos(i**1.5 / 90), math.sin(i**1.5 / 90)]) for i in range(60)], "id long, v array<double>")
    asked = rows.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    take = lambda df: sorted((r.q, r.id, r.rank) for r in df.collect())
    whole = take(R.vector_topk(rows, asked, "q", "qv", "id", "v", 3))
    assert len(whole) == 180 and take(R.vector_topk(rows, asked, "q", "qv", "id", "v", 3, block=13)) == whole
    assert take(R.vector_topk_blas(rows, asked, "q", "qv", "id", "v", 3, block=13)) == whole


def test_chunk_sweep(spark):
    docs = [("d1", "Hip turn", "the hips turn early. they turn again."), ("d2", "Barrel", "the barrel stays long. it stays flat."), ("d3", "Eyes", "eyes follow the ball. eyes stay still.")]
    rows = [(d, t, i, i * 5, s.strip() + ".") for d, t, text in docs for i, s in enumerate(x for x in text.split(".") if x.strip())]
    sentences = spark.createDataFrame(rows, "doc string, title string, n int, ts int, sentence string")
    questions = spark.createDataFrame([("1", "when do hips turn", ["hip"]), ("2", "flat barrel", ["barrel"]), ("3", "zzz", ["eyes"])], "id string, q string, expect_sources array<string>")
    got = {(r["size"], r["overlap"]): (r.n, round(r.recall_1, 4)) for r in V.chunk_sweep(sentences, questions, V.grid([4, 50], [0, 2], spark), ["doc"], "n").collect()}
    assert got == {(4, 0): (3, 0.6667), (4, 2): (3, 0.6667), (50, 0): (3, 0.6667), (50, 2): (3, 0.6667)}


def test_token_counts(spark):
    row = spark.createDataFrame([("a b-c!",)], "t string").select(T.token_count(F.col("t")), T.token_count(F.col("t"), len)).first()
    assert tuple(row) == (5, 6)


def test_inverted_lists_against_all_pairs(spark, tmp_path, monkeypatch):
    from braidwork.operators import nearest as N

    rng = np.random.default_rng(1)
    x = N.unit(rng.normal(size=(600, 8)) + 3 * rng.normal(size=(12, 8))[rng.integers(0, 12, 600)])
    x[:200] = x[0]  # a list that holds a third of all
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>")
    asked = rows.where("id % 50 = 0 AND id < 9999").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    monkeypatch.setattr(N, "BLOCK", 37)
    index = N.build(rows, "id", "v", str(tmp_path / "ix"), lists=20)
    assert index.rows.count() == 600 and index.sizes.agg(F.max("blocks")).first()[0] > 1
    take = lambda df: sorted((r.q, r.rank, r.id) for r in df.collect())
    exact = R.vector_topk(rows.where("v IS NOT NULL"), asked, "q", "qv", "id", "v", 5)
    assert take(N.search_exact(index, asked, "q", "qv", 5, 1)) == take(exact)
    found = N.recall(N.search(index, asked, "q", "qv", 5), exact, "q", "id").agg(F.avg("recall")).first()[0]
    assert found >= 0.9
    assert N.search_exact(N.build(rows.limit(0), "id", "v", str(tmp_path / "none")), asked, "q", "qv", 5).count() == 0


def test_blocks_give_the_same_and_read_less(spark, tmp_path, monkeypatch):
    from braidwork.operators import blocks as K

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(0, 40), p=weight / weight.sum())) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    asked = spark.createDataFrame([(1, "w0 w1 w59 w58"), (2, "w50 w50 w3"), (3, "none"), (4, "w0")], "q int, text string")
    index = R.build_index(docs, "id", "t", str(tmp_path / "ix"))
    monkeypatch.setattr(K, "BLOCK", 16)
    packed = K.pack(index, "id", str(tmp_path / "blocks"))
    take = lambda df: sorted((r.q, r.rank, r.id, r.score) for r in df.collect())
    for k in (1, 3, 10):
        assert take(K.topk(packed, asked, "q", "text", "id", k)) == take(R.bm25_topk(index, asked, "q", "text", "id", k))
    share = {r.q: (r.postings, r.read) for r in K.read_share(packed, asked, "q", "text", "id", 3).collect()}
    assert all(read <= n for n, read in share.values()) and share[1][1] < share[1][0]


def test_blocks_of_shards_give_the_same(spark, tmp_path, monkeypatch):
    """Whatever the shards and blocks: texts of null and of no words, repeated and null numbers, names, words that most documents have."""
    from braidwork.operators import blocks as K

    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    weight = 1 / np.arange(1, 31)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30), p=weight / weight.sum()))) for i in range(200)]
    rows += [(3, "w7 w7 w29"), (300, None), (301, ""), (None, "w1 w29 w29"), *((400 + i, "w1 w2 w2 w28") for i in range(20))]
    docs = spark.createDataFrame(rows, "id int, t string")
    asked = spark.createDataFrame([(1, "w0 w1 w29 w28"), (2, "w20 w20 w3"), (3, "none"), (4, "w0"), (5, None), (6, "w1 w2 w28"), (None, "w1")], "q int, text string")
    monkeypatch.setattr(K, "BLOCK", 4)
    monkeypatch.setattr(K, "SHARD", 150)
    take = lambda df: sorted((r.q, r.rank, r.id, r.score) for r in df.where("q IS NOT NULL").collect())
    for kind in ("int", "string"):
        own = docs.withColumn("id", F.col("id").cast(kind))
        index = R.build_index(own, "id", "t", str(tmp_path / kind / "ix"))
        built = K.build(own, "id", "t", str(tmp_path / kind / "blocks"))
        assert built.blocks.select("shard").distinct().count() > 20 and built.blocks.agg(F.max(F.size("at"))).first()[0] == 4
        weights = [sorted((r.term, round(r.idf, 9)) for r in terms.collect()) for terms in (built.terms, index[2])]
        assert weights[0] == weights[1]
        for k in (1, 4):
            assert take(K.topk(built, asked, "q", "text", "id", k)) == take(R.bm25_topk(index, asked, "q", "text", "id", k))
    share = {r.q: (r.postings, r.read) for r in K.read_share(built, asked, "q", "text", "id", 3).collect()}
    assert set(share) == {1, 2, 4, 6} and all(read <= n for n, read in share.values()) and share[1][1] < share[1][0]
    assert take(K.topk(K.build(docs.limit(0), "id", "t", str(tmp_path / "none")), asked, "q", "text", "id", 2)) == []
    few = docs.where("id > 300")  # a word of nearly all documents: no weight is over 0, and every posting counts
    assert take(K.topk(K.build(few, "id", "t", str(tmp_path / "few")), asked, "q", "text", "id", 30)) == take(R.bm25_topk(R.build_index(few, "id", "t", str(tmp_path / "plain")), asked, "q", "text", "id", 30))


def _moved(spark, work):
    """Rows that the stages of `work` have given to shuffles."""
    gateway, context = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        told = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {told.apply(i).stageId(): told.apply(i).shuffleWriteRecords() for i in range(told.size())}

    before = stages()
    work()
    return sum(n for k, n in stages().items() if k not in before)


def test_blocks_move_no_postings(spark, tmp_path):
    """Less moves than there are postings of the terms asked for: neither they nor pairs of a query and a document are shuffled."""
    from braidwork.plans import search

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(640)]
    spark.createDataFrame(list(enumerate(texts[:600])), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(texts[600:])), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    postings = sum(len(set(t.split())) for t in texts[:600])
    got = []
    assert _moved(spark, lambda: got.extend(search.bm25_blocks(spark, str(tmp_path)).collect())) < postings
    assert len(got) == 200


def test_word_edges_are_of_ascii(spark):
    """As SQL has them: an accented letter ends a word, lines end at line feeds alone, cases of all scripts are one."""
    said = ["por la la la\xf1 del la la\xf1o.", "oh\u2028then oh", "yeah\rso yeah", "so that'ſ it for now", "ſtay tuned", "oh\nthen oh", "xoh ohx"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "n int, s string")
    found = rows.select("n", T.matches(F.col("s"), [*S.LYRICS, *S.SIGN_OFFS]).alias("m")).orderBy("n").collect()
    import duckdb

    sql = duckdb.sql("SELECT " + ", ".join("regexp_matches($%d, '%s')" % (i + 1, ("(?i)" + "|".join(f"(?:{p})" for p in [*S.LYRICS, *S.SIGN_OFFS])).replace("'", "''")) for i in range(len(said))), params=said).fetchall()[0]
    assert [r.m for r in found] == list(sql) == [True, True, True, True, False, False, False]


def test_reasons_next_to_accented_letters(spark):
    rows = spark.createDataFrame([(1, 0, "Ierier de la la\xf1 con la la\xf1o.", 0), (1, 1, "Ierier de la lan con otra cosa.", 1)], "k int, n int, text string, ts int").withColumn("duration", F.lit(0))
    told = S.classify(rows, ["k"])
    assert [r.reason for r in told.orderBy("n").collect()] == ["music/lyrics", None]
    report = S.removal_report(told).collect()
    assert [(r.reason, r.n, r.total, r.kept) for r in report] == [("music/lyrics", 1, 2, 1)]
    assert spark.range(1).select(A.verdict(F.lit("this long enough \xe9which of them"), F.lit("q"), A.Policy(banned=(r"\bwhich\b",))).alias("v")).first().v == "banned claim: 'which'"


def test_vectors_in_tiles(spark, monkeypatch):
    """Whatever the tiles, the k best and their ties are those of all pairs, and a task gives k rows a query and not more."""
    rng = np.random.default_rng(5)
    some = rng.normal(size=(40, 8))
    own = np.concatenate([some, some[:20], some[:20]])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "id long, v array<double>").repartition(3)
    asked = rows.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    monkeypatch.setattr(R, "TILE", 7)
    monkeypatch.setattr(R, "ROWS", 5)
    scores = np.round(own @ own.T, 12)
    for self_ in (False, True):
        got = {}
        for r in R.vector_topk(rows, asked, "q", "qv", "id", "v", 4, exclude_self=self_).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.id)
        assert got == {q: [i for i in sorted(range(len(own)), key=lambda i: (-scores[q, i], i)) if not (self_ and i == q)][:4] for q in range(len(own))}
    best = None
    for cut in range(0, len(own), 5):
        best = R._nearer(best, own[:7] @ own[cut : cut + 5].T, np.arange(cut, min(cut + 5, len(own))), 4)
        assert len(best[0]) <= 28
    assert len(best[0]) == 28


def test_postings_meet_at_their_document(spark, tmp_path):
    """An index knows its documents' lengths without a join, null and repeated rows too; scores don't depend on how documents are dealt."""
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "c c d"), (1, "d e")], "id long, text string")
    assert {(r.term, r.id, r.tf, r.dl) for r in R.word_counts(docs, "id", "text").where("id IN (1, 3)").collect()} == {("a", 1, 1, 5), ("b", 1, 2, 5), ("d", 1, 1, 5), ("e", 1, 1, 5), ("", 3, 0, 0)}
    asked = spark.createDataFrame([(7, "b d d")], "q long, t string")
    plain = {r.id: r.score for r in R.bm25_scores(R.bm25_index(docs, "id", "text"), asked, "q", "t", "id").collect()}
    built = {r.id: r.score for r in R.bm25_scores(R.build_index(docs, "id", "text", str(tmp_path)), asked, "q", "t", "id").collect()}
    assert plain == built and set(plain) == {1, 2, 4}


def test_notes_are_dealt_to_tasks_by_their_size(spark, monkeypatch):
    """A task's share does not grow with the notes, and their lines are dealt once."""
    monkeypatch.setattr(M, "TASK_BYTES", 1000)
    notes = spark.createDataFrame([(f"n{i % 40}.md", f"# Head {i % 40}\n\n" + "A line of words.\n" * 20) for i in range(80)], "name string, text string")
    own = M.noted(notes)
    assert own.count() == 40 and own.rdd.getNumPartitions() == -(-notes.selectExpr("sum(octet_length(text))").first()[0] // 1000)
    made = M.glued(M.sections(M.blocks(own)), ["_key", "section"])
    assert made.count() == 40 and made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_sweep_scores_chunks_where_their_postings_are(spark, monkeypatch):
    """What questions and chunks share is summed in the chunk's task and not shuffled, in as many tasks as the pairs ask for."""
    monkeypatch.setattr(V, "SCORED", 10)
    sentences = spark.createDataFrame([(f"d{i % 9}", f"Title {i % 9}", i, i, f"the hips turn {i % 9} times.") for i in range(90)], "doc string, title string, n int, ts int, sentence string")
    questions = spark.createDataFrame([(str(i), f"hips turn {i}", [f"title {i}"]) for i in range(9)], "id string, q string, expect_sources array<string>")
    told = V.chunk_sweep(sentences, questions, V.grid([5, 20], [0], spark), ["doc"], "n")
    assert {(r["size"], r.n, r.recall_1) for r in told.collect()} == {(5, 9, 1.0), (20, 9, 1.0)}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(size#\d+L?, overlap#\d+L?, q_id#\d+L?, id#", plan)
    assert re.search(r"Exchange hashpartitioning\(size#\d+L?, overlap#\d+L?, id#\d+L?, \d{2,}\)", plan), plan


def test_notes_are_chunked_in_one_shuffle(spark):
    """Texts move once, when notes are dealt to tasks, and no table is written on the way; a counter of the caller's changes no row."""
    texts = [MARKDOWN, "# Clip [abcdefgh12]\n\n- **Source video:** `c.mp4`\n", *(f"# T{i}\n\n" + "\n\n".join(f"## S{j % 4}\n\n- one\n\n" + "Some words of it go here. " * (9 * j + i) for j in range(7)) for i in range(5))]
    notes = spark.createDataFrame([(f"n{i}.md", t) for i, t in enumerate(texts)], "name string, text string")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    there = set(shared.glob("*"))
    made = M.chunk_notes(notes)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = sorted(made.collect())
    assert set(shared.glob("*")) == there
    by_note = {t: [r for r in rows if r.source_title == t] for t in {r.source_title for r in rows}}
    assert set(by_note) == {f"n{i}" for i in (0, *range(2, 7))}  # facts alone make no child
    for own in by_note.values():
        assert sorted(r.chunk_index for r in own) == list(range(len(own)))
        seen = list(dict.fromkeys(r.parent_text for r in sorted(own, key=lambda r: r.chunk_index)))
        assert all(r.parent_id == f"{r.source_title}::p{seen.index(r.parent_text):03d}" for r in own)
    assert sorted(M.chunk_notes(notes, count=M.words_and_marks).collect()) == rows


def test_pieces_by_hand(spark):
    told = [("para", "1."), ("para", "Do it:"), ("list", "- a"), ("para", "cut in"), ("para", " two. "), ("list", "- **Duration:** 1:05"), ("table", "| a |"), ("para", "no end")]
    rows = spark.createDataFrame([(1, told), (2, [("list", "- **Duration:** 1:05")]), (3, [])], "k int, blocks array<struct<kind: string, text: string>>")
    got = {r.k: [tuple(p) for p in r.pieces] for r in rows.select("k", M.pieces_of(F.col("blocks")).alias("pieces")).collect()}
    assert got == {1: [("para", "1. Do it:\n\n- a cut in two. "), ("table", "| a |"), ("para", "no end")], 2: [], 3: []}
    assert [(r.n, r.kind, r.text) for r in M.glued(rows, ["k"]).orderBy("k", "n").collect()] == [(i, *p) for i, p in enumerate(got[1], 1)]
