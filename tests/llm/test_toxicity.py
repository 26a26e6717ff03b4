import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import toxicity as T


def test_parts_follow_crc32(spark, docs_of):
    got = {r.doc_id: r.p for r in docs_of(["x"] * 50).select("doc_id", T.part_of(F.col("doc_id")).alias("p")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}


def brute_model(docs):
    """{k: {gram: [n0, n1]}} and discounts, straight from the definition."""
    words = defaultdict(lambda: [0, 0])
    for text, toxic in docs:
        for w in set(text.lower().split()):
            words[w][toxic] += 1
    padded = {T.BEGIN + w + T.END: n for w, n in words.items()}
    out = {T.ORDER: defaultdict(lambda: [0, 0])}
    for w, n in padded.items():
        for i in range(len(w) - T.ORDER + 1):
            for c in (0, 1):
                out[T.ORDER][w[i : i + T.ORDER]][c] += n[c]
    for k in range(T.ORDER - 1, 0, -1):
        out[k] = defaultdict(lambda: [0, 0])
        for g, n in out[k + 1].items():
            for c in (0, 1):
                out[k][g[1:]][c] += n[c] > 0
        if k > 1:
            for w, n in padded.items():
                if len(w) >= k:
                    for c in (0, 1):
                        out[k][w[:k]][c] += n[c]
    return out


def brute_evidence(word, model):
    total = 0.0
    w = T.BEGIN + word + T.END
    discounts = {}
    for k, grams in model.items():
        sizes = Counter(sum(n) for n in grams.values())
        discounts[k] = min(0.95, max(0.1, sizes[1] / max(1, sizes[1] + 2 * sizes[2])))
    for i in range(1, len(w)):
        p = [1 / 256, 1 / 256]
        for k in range(1, T.ORDER + 1):
            if i < k - 1:
                continue
            context = w[i - k + 1 : i]
            around = {g: n for g, n in model[k].items() if g[:-1] == context}
            for c in (0, 1):
                ns = {g: sum(n) if k <= T.SHARED else n[c] for g, n in around.items()}
                if k <= T.SHARED:
                    off, mass = discounts[k], discounts[k] * len(ns)
                else:
                    off, mass = T.RARE, sum(min(n, T.RARE) for n in ns.values())
                if sum(ns.values()):
                    p[c] = (max(ns.get(context + w[i], 0) - off, 0) + mass * p[c]) / sum(ns.values())
        total += math.log(max(p[1], 1e-12)) - math.log(max(p[0], 1e-12))
    return total


def told_gains(spark, docs, more=()):
    """{gram: gain in nats' parts} of a model trained on docs, for their words and for those of the texts in `more`."""
    rows = [(i, t) for i, t in enumerate([t for t, _ in docs] + list(more))]
    coded = T.chunks(spark.createDataFrame(rows, "doc_id long, text string"))
    trained = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(docs)], "key long, toxic int")
    return {r.gram: r.gain for r in T.gains(T.asked(coded, trained)).collect()}


@pytest.mark.parametrize("chunk_chars", [1, T.CHUNK_CHARS])
def test_evidence_against_brute_force(spark, monkeypatch, chunk_chars):
    """Exact, however the documents fall into chunks."""
    monkeypatch.setattr(T, "CHUNK_CHARS", chunk_chars)
    random.seed(8)
    vocab = ["".join(random.choices("abcdéx", k=random.randint(1, 9))) for _ in range(60)]
    docs = [(" ".join(random.choices(vocab[:50], k=20) + (random.choices(vocab[50:], k=3) if t else [])), t) for t in (random.randint(0, 1) for _ in range(60))]
    brute = brute_model(docs)
    words = [*vocab, "unseen", "a", "zz😀"]
    got = T.word_gains(words, told_gains(spark, docs, [" ".join(words)])) / T.PARTS
    assert np.abs(got - [brute_evidence(w, brute) for w in words]).max() < 1e-6


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "tion", "lo", "ha", "mi", "ur", "be"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    stems = ["grxav", "plomf"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(3, 6) * toxic):
            words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(syllables)
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark, docs_of):
    rows = corpus(600, 9)
    docs = docs_of([t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    return rows, docs, labels, {r.doc_id: r.score for r in T.score(docs, labels).collect()}


def part(i):
    return zlib.crc32(str(i).encode()) % 4


def test_held_out_accuracy(scored):
    rows, _, _, got = scored
    held = [(x, got[i] >= T.THRESHOLD) for i, _, x in rows if part(i) == 2]
    assert sum(p for x, p in held if x) >= 0.9 * sum(x for x, _ in held)
    assert sum(p for x, p in held if not x) <= 0.03 * sum(1 - x for x, _ in held)


def test_held_out_labels_are_not_used(spark, scored):
    rows, docs, _, got = scored
    turned = spark.createDataFrame([(i, 1 - x if part(i) == 2 else x) for i, _, x in rows], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in T.score(docs, turned).collect()} == got


def test_chunks_do_not_change_scores(scored, monkeypatch):
    _, docs, labels, got = scored
    monkeypatch.setattr(T, "CHUNK_CHARS", 5_000)
    again = {r.doc_id: r.score for r in T.score(docs.repartition(7), labels).collect()}
    assert again.keys() == got.keys() and max(abs(again[k] - got[k]) for k in got) < 1e-9


def test_long_texts_are_dealt_to_chunks(spark, docs_of, scored, monkeypatch):
    """A text of many chunks scores as one of a single chunk does; no chunk's words grow with it, none is in two."""
    rows, _, labels, _ = scored
    texts = [t for _, t, _ in rows] + [" ".join(t for _, t, _ in rows[:200]) + " grxavlo plomfan", " \u2003" * 300, "y" * 700 + " İx ΑΣ"]
    whole = [r.score for r in T.score(docs_of(texts), labels).orderBy("doc_id").collect()]
    monkeypatch.setattr(T, "CHUNK_CHARS", 400)
    made = T.chunks(docs_of(texts).where(f"doc_id >= {len(rows)}")).collect()
    first = [w for r in made if len(r.docs) == 1 and r["keys"] == [len(rows)] for w in T._words(r)]
    assert len(first) == len(set(first)) and set(first) == set(texts[len(rows)].lower().split())
    assert all(sum(map(len, T._words(r))) <= 400 or len(T._words(r)) == 1 for r in made) and len(made) > 10
    parted = [r.score for r in T.score(docs_of(texts), labels).orderBy("doc_id").collect()]
    assert np.abs(np.array(whole) - parted).max() < 1e-9


def test_cross_validation_tells_noise_from_signal():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 3)), np.arange(400) // 20 % 2
    told = x + y[:, None] * 3
    assert T.cross_validated(told, y) < 0.1 and 0.68 < T.cross_validated(x, y) < 0.8
    assert T.cross_validated(x, y * 0) < 0.01


def test_odd_rows(spark, scored):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names."""
    rows, _, labels, _ = scored
    texts = ["", None, " \n", "grxavlo " * 20_000, "x" * 50_000, "grxavan plomfer", "grxavan plomfer"]
    odd = [(1000 + i, t, 0) for i, t in enumerate(texts)] + [(None, "er an", 0), (None, "er an", 0)]
    every = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + odd, "`a.id` long, text string, key int")
    every = every.select("*", F.lit(1).alias("f0"), F.lit("x").alias("chunk"), F.lit(2).alias("words"))
    marks = labels.select(F.col("doc_id").alias("a.id"), "toxic").union(labels.limit(5)).union(spark.createDataFrame([(None, 1), (3, None)], "x long, toxic int"))
    out = T.score(every, marks, "a.id").collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    got = {r["a.id"]: r.score for r in out}
    assert got[1000] == got[1001] == got[1002] and got[1005] == got[1006] > 0.5
    assert len([r for r in out if r["a.id"] is None]) == 2


def test_few_labels_and_no_rows(spark, docs_of, scored):
    _, docs, labels, _ = scored
    assert T.score(docs.limit(0), labels).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert all(0 <= r.score <= 1 for r in T.score(docs.limit(40), few).collect())


def test_rows_beyond_the_fit_are_counted(spark, docs_of):
    rows = corpus(120, 10)
    third = [i for i, _, _ in rows if part(i) == 3]
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    trained, sample = T.shares(labels, fit_rows=5)
    chosen = {r.key for r in sample.collect()}
    assert len(chosen) == 5 and chosen <= set(third)
    assert {r.key for r in trained.collect()} == {i for i, _, _ in rows if part(i) != 2} - chosen
    docs = docs_of([t + " wzqxkvj" * (i in third) for i, t, _ in rows])
    counted = T.asked(T.chunks(docs), trained).where(F.col("gram") == "wzqxkvj"[: T.ORDER]).agg(F.sum(F.col("n0") + F.col("n1"))).first()[0]
    assert counted == len(third) - 5 > 0
