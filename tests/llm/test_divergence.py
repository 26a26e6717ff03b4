import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidwork.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, least, top=10):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((x or "" for x in r) for r in rows):
        words = TERM.findall(lowered(text))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, source in counts:
        kept = sorted((w for w, n in docs[lang].items() if n >= least), key=str.encode)
        v, others = len(kept), [s for x, s in counts if x == lang]
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * v) for w in kept}  # noqa: E731, B023
        far = lambda x, y: (x - y) * (x - y) // (x + y)
        whole = sum((counts[lang, s] for s in others), Counter())
        own, every = p(counts[lang, source]), p(whole)
        pairs = [(-sum(far(own[w], q[w]) for w in kept), s) for s in others if s != source for q in [p(counts[lang, s])]]
        terms = [(-far(own[w], every[w]), w) for w in kept if counts[lang, source][w] and own[w] > every[w]]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else top]
            out += [(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["The", "the", "naïve", "É", "é", "日本", "a", "aa", "aaa", "aaab", "😀x", "under_score", "x1y", *("w" * k for k in range(1, 8))]
    return [(rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 40)))]), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s1", "é", None, "S2"])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "least"), [(1, 10), (2, 3), (3, 1000)])
def test_against_brute_force(spark, monkeypatch, seed, least):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "`a.b` int, text string, lang string, source string").repartition(5)
    got = sorted(tuple(r) for r in D.audit(docs, least_docs=least).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, least)


def test_blocks_of_sources_and_flushes(spark, monkeypatch):
    """More sources than a block has, tries written out again and again: the same rows."""
    monkeypatch.setattr(D, "SOURCES", 2)
    rows = corpus(4, 120)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert sorted(tuple(r) for r in D.audit(docs, least_docs=5).select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows, 5)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_tries_merge_to_the_counts_of_all():
    rng = random.Random(7)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(3000)]
    want, merged = Counter(words), D.Trie()
    for at in range(0, len(words), 500):
        trie = D.Trie()
        for w in words[at : at + 500]:
            leaf = trie.leaf(w)
            leaf[0] += 1
            leaf[1]["s"] = leaf[1].get("s", 0) + 1
        by = defaultdict(D.Trie)
        for prefix, branch in trie.branches(3):
            D._grown(by[prefix], D._told(branch))
        for prefix, part in by.items():
            for w, leaf in part.walk():
                merged.merge([prefix + w, {}, leaf])
    got = [(w, leaf[0], leaf[1]["s"]) for w, leaf in merged.walk()]
    assert got == [(w, want[w], want[w]) for w in sorted(want)]


def test_deep_branches_are_told_leaf_by_leaf():
    trie = D.Trie()
    for n in range(1, 3000):
        trie.leaf(b"a" * n)[0] = n
    again = D.Trie()
    for prefix, branch in trie.branches(3):
        told = D._told(branch)
        part = D.Trie()
        D._grown(part, told)
        for w, leaf in part.walk():
            again.merge([prefix + w, {}, leaf])
    assert [(w, leaf[0]) for w, leaf in again.walk()] == [(b"a" * n, n) for n in range(1, 3000)]


def test_shares_are_exact():
    rng = random.Random(8)
    for _ in range(300):
        total, terms = rng.randint(0, 8 * 10**15), rng.randint(1, 10**6)
        count = rng.randint(0, total)
        assert int(D.shares(np.array([count]), np.array([total]), terms)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * terms)
