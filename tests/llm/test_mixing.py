import math
import random
from collections import Counter, defaultdict

import pytest

from braidwork.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(6)
    sizes = {"big": 900, "mid": 300, "small": 60, None: 40}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "w " * random.randint(1, 40), "en", s, None))
            i += 1
    return spark.createDataFrame(rows, SCHEMA), rows


def tokens_by_source(rows):
    out = Counter()
    for r in rows:
        out[r[3]] += len((r[1] or "").split())
    return out


def entropy(shares):
    return -sum(x * math.log(x) for x in shares if x)


def bisect(shares, good):
    low, high = 0.0, 1.0
    if good(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def weights(shares, a):
    z = sum(x**a for x in shares.values())
    return {s: x**a / z for s, x in shares.items()}


def test_evenness_target(corpus):
    docs, rows = corpus
    have = tokens_by_source(rows)
    total = sum(have.values())
    shares = {s: n / total for s, n in have.items()}
    a = bisect(shares, lambda a: entropy(weights(shares, a).values()) / math.log(len(shares)) <= 0.85)
    got = mixing.mix(docs, budget=2.0, evenness=0.85).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens
    for s, w in weights(shares, a).items():
        assert w * 2 * total - 41 <= used[s] <= w * 2 * total + 1


def test_passes_are_whole_and_blocks_differ(corpus):
    docs, rows = corpus
    got = mixing.mix(docs, budget=3.0, evenness=0.9).collect()
    by = defaultdict(Counter)
    for r in got:
        by[r.source, r.epoch][r.doc_id] += 1
    ids = defaultdict(set)
    for r in rows:
        ids[r[3]].add(r[0])
    last = {s: max(e for t, e in by if t == s) for s in ids}
    for (s, e), seen in by.items():
        assert set(seen.values()) == {1}
        if e < last[s]:
            assert set(seen) == ids[s]


def test_repetition_limit_and_every_document_stays(corpus):
    docs, rows = corpus
    again = Counter(r.doc_id for r in mixing.remixed(docs, max_repetition=1.5).collect())
    assert set(again) == {r[0] for r in rows} and set(again.values()) == {1, 2}
    have, used = tokens_by_source(rows), Counter()
    for r in rows:
        used[r[3]] += len(r[1].split()) * again[r[0]]
    assert used["big"] == have["big"]
    assert max(used[s] / have[s] for s in have) == pytest.approx(1.5, abs=0.1)
    assert mixing.remixed(docs, max_repetition=1.5).columns == docs.columns


def test_repeats_exactly(corpus):
    docs, _ = corpus
    take = lambda df: sorted(map(tuple, df.select("doc_id", "epoch").collect()))
    assert take(mixing.mix(docs, budget=1.0, evenness=0.85)) == take(mixing.mix(docs.repartition(7), budget=1.0, evenness=0.85))


def test_odd_rows(spark):
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", None), (3, "x y", "en", "b", None), (3, "x y", "en", "b", None), (None, "z", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter(r.doc_id for r in mixing.remixed(docs, max_repetition=2.0).collect())
    assert {1, 2, 3, None} <= set(got)
    assert mixing.mix(docs.limit(0), budget=1.0, evenness=0.9).count() == 0
    assert mixing.remixed(docs.where("doc_id < 3"), max_repetition=2.0).count() == 2


def test_many_sources_are_joined_by_shuffle_alike(corpus, monkeypatch):
    docs, _ = corpus
    take = lambda: sorted(map(tuple, mixing.mix(docs, budget=1.7, evenness=0.9).select("doc_id", "epoch", "turn").collect()))
    sent = take()
    monkeypatch.setattr(mixing, "SENT_ROWS", 0)
    assert take() == sent
