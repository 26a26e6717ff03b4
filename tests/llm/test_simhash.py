import random

import numpy as np
import xxhash

from braidwork.llm import graph, simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = dict(prints)
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_code_is_perfect_and_covers():
    code = simhash.covering_code()
    assert sum(b.bits for b in code) == 64
    for b in code:
        counts, _, _ = b.by_excess[0]
        assert (counts == 1).all()
    rng = np.random.default_rng(0)
    own = rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2) + rng.integers(0, 2, 400).astype(np.uint64)
    home = simhash.homes(own, code)
    for flips in (0, 1, 2):
        near = own.copy()
        for i in range(len(near)):
            for b in rng.choice(64, flips, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        rows, anchors = simhash.replicas(near, code)
        reach = set(zip(rows.tolist(), anchors.tolist(), strict=True))
        assert len(reach) == len(rows)
        assert all((i, int(home[i])) in reach for i in range(len(near)))
        assert (np.bitwise_count(near[rows] ^ anchors) <= 8 + 2).all()


def test_against_brute_force(docs_of):
    random.seed(1)
    vocab = ["".join(random.choices("abcdefgh", k=4)) for _ in range(300)]
    base = [" ".join(random.choices(vocab, k=random.randint(1, 400))) for _ in range(60)]
    texts = list(base) + ["", None, " \t\n", "one", "One TWO", "one two three", "É é"]
    for t in base:
        words = t.split()
        for _ in range(3):
            w = list(words)
            w[random.randrange(len(w))] = random.choice(vocab)
            texts.append(" ".join(w))
    texts += [base[0]] * 5 + [base[0].upper(), "word " * 30_000]
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs_of(texts)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (1 << 64) - 1 for i, r in rows.items()} == prints
    assert {i: r.component_id for i, r in rows.items()} == brute_components(prints)
    assert any(r.component_id != i for i, r in rows.items() if i >= 70)


def test_repeated_rows_and_empty_table(docs_of):
    two = docs_of(["a b c d"]).union(docs_of(["a b c d"]))
    assert [r.component_id for r in simhash.near_duplicates(two).collect()] == [0, 0]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (7, 7)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
