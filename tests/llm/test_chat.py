import hashlib
import random

from pyspark.sql import functions as F

from braidwork.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def brute_paths(rows):
    known = {(t, n): p for t, n, p, *_ in rows}
    parents = {(t, p) for t, n, p, *_ in rows if p is not None and (t, p) in known}
    out = {}
    for t, n in known:
        if (t, n) in parents:
            continue
        path, at, seen = [], n, set()
        while at is not None and (t, at) in known and at not in seen:
            seen.add(at)
            path.append(at)
            at = known[t, at]
        out[t, n] = path[::-1]
    return out


def test_paths_against_brute_force(spark):
    random.seed(7)
    rows = []
    for tree in range(6):
        n = random.choice([1, 2, 5, 40])
        for i in range(n):
            rows.append((tree, i, random.choice([None, *range(i)]) if i and random.random() < 0.9 else None, "user", "t", 0.0))
    rows += [(9, i, i - 1 if i else None, "user", "t", 0.0) for i in range(70)]
    rows += [(10, 1, 99, "user", "orphan", 0.0), (11, 1, 2, "user", "circle", 0.0), (11, 2, 1, "user", "circle", 0.0)]
    got = {}
    for r in chat.paths(spark.createDataFrame(rows, SCHEMA)).orderBy("tree", "leaf", "depth").collect():
        got.setdefault((r.tree, r.leaf), []).append(r.node)
        assert r.depth == len(got[r.tree, r.leaf]) - 1
    assert got == {k: v for k, v in brute_paths(rows).items()}


def test_branches_rank_by_score(spark):
    rows = [(1, 0, None, "user", "q", None), (1, 1, 0, "assistant", "good", 3.0), (1, 2, 0, "assistant", "bad", 1.0), (1, 3, 1, "user", "more", 1.0), (1, 4, 0, "assistant", "tie", 1.0)]
    done = {r.branch: r for r in chat.format_trees(spark.createDataFrame(rows, SCHEMA), chosen=3).collect()}
    assert {b: r.leaf for b, r in done.items()} == {1: 3, 2: 2, 3: 4}
    assert done[1].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    s = done[1].loss_spans[0]
    assert done[1].formatted[s.start : s.end] == "good"


TEXTS = ["", None, "<|im_end|>", "<|im_end|>\n<|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "<<||", "a\nb\\n", "é😀<|", "$1 \\1 \\$"]


def test_round_trip(spark):
    rows = [(i, 0, None, r, t, 0.0) for i, (r, t) in enumerate((r, t) for r in ("assistant", "a\nb", "x\\n<|y", "\\", None, "n\\\\n\n") for t in TEXTS)]
    done = chat.format_trees(spark.createDataFrame(rows, SCHEMA)).select("tree", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert len(done) == len(rows)
    for r in done:
        assert [(t.role, t.text) for t in r.turns] == [(rows[r.tree][3] or "", rows[r.tree][4] or "")]
        assert len(r.loss_spans) == (rows[r.tree][3] == "assistant")


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (1, 2, "assistant", None), (2, 5, "system", "s"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 1, None, "x"), (4, None, "assistant", "first"), (None, 1, "user", "whose?")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op6_chat(spark, str(tmp_path)).collect()}
    want = {1: rows[:3], 2: [rows[3]], 3: rows[4:6], 4: [rows[7], rows[6]], None: [rows[8]], -1: [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]}
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_messages(spark):
    assert chat.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0
