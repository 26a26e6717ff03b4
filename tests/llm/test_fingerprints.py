import hashlib
import random

import pytest

from braidwork.llm import fingerprints as P

TEXTS = ["", None, "a", "ab", "é😀" * 40, "plain text of some length, " * 30, "plain text of some length, " * 30, "another one altogether; " * 50, "x" * 100_000]


def hashed(codes):
    """The hash by its definition, without prefix arrays."""
    out = 0
    for base in P.BASES:
        out = out << 31 | sum((c + 1) * pow(base, i, P.PRIME) for i, c in enumerate(codes)) % P.PRIME
    return out


def test_any_span_by_definition():
    rng = random.Random(1)
    text = "".join(rng.choices("abé😀 ", k=700))
    sums = P.Prefixes(text)
    for _ in range(200):
        i, j = sorted(rng.choices(range(701), k=2))
        assert sums.span(i, j) == hashed([*map(ord, text[i:j])])


def test_equal_spans_and_extensions(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(P, "CHUNK", 64)
    for _ in range(100):
        stem = "".join(rng.choices("ab", k=rng.randint(0, 300)))
        a, b = (rng.choice(["", "xy", "yxy"]) + stem + "".join(rng.choices("ab", k=rng.randint(0, 50))) for _ in range(2))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        want = next((k for k, (x, y) in enumerate(zip(a[i:], b[j:], strict=False)) if x != y), min(len(a) - i, len(b) - j))
        assert P.Prefixes(a).extension(i, P.Prefixes(b), j) == want


def test_windows_by_definition(monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 50)
    text = "".join(random.Random(3).choices("abc", k=333))
    got = sorted({int(x) for part in P.Prefixes(text).windows() for x in part})
    want = sorted({int(P._mixed(P.np.array([hashed([*map(ord, text[i : i + P.WINDOW])])], P.np.uint64))[0]) for i in range(len(text) - P.WINDOW + 1)})
    assert got == want
    print_ = P.Prefixes(text).fingerprint()
    assert print_[16:] == b"".join(x.to_bytes(P.BYTES) for x in want[: P.LEAST]) and print_[:8] == len(text).to_bytes(8)


def brute(rows):
    """(n_chars, edited_sha256, likenesses, common prefix) by key, for distinct keys."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (k, t) in enumerate(order):
        a, b = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(a) // 3
        changed = a[: len(a) - n] + b[:n]
        of = lambda s: P.Prefixes(s).fingerprint()
        same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        out[k] = (len(a), hashlib.sha256(changed.encode()).digest(), of(a), of(changed), P.likeness(of(a), of(changed)), P.likeness(of(a), of(b)), same)
    return out


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[:1], TEXTS[4:6], [f"text {i} " * (i % 9) for i in range(150)]])
def test_with_next_against_brute_force(spark, docs_of, texts):
    rows = P.with_next(docs_of(texts).repartition(3)).collect()
    want = brute(list(enumerate(texts)))
    assert {r.doc_id: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]) for r in rows} == want


def test_empty_table_nulls_repeats_and_names(spark, docs_of):
    assert P.with_next(docs_of([])).count() == 0
    rows = [(5, "same", 1)] * 40 + [(None, None, None), (3, "other", 2)]
    docs = spark.createDataFrame(rows, "`a.b` int, text string, _part int")
    got = P.with_next(docs, key="a.b", keep=("_part",)).collect()
    assert len(got) == 42 and sum(r.near_next == 1.0 for r in got) == 39
    assert sorted((r["a.b"] or 0, r._part or 0) for r in got) == sorted((a or 0, p or 0) for a, _, p in rows)


def test_likeness_tells_edits_from_others():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    for n in (30, 200, 1500):
        a, b = prose(n), prose(n)
        of = lambda s: P.Prefixes(s).fingerprint()
        assert P.likeness(of(a), of(a)) == 1.0 and P.likeness(of(a), of(P.edited(a, b))) > 0.2 and P.likeness(of(a), of(b)) < 0.1
    assert P.likeness(of(""), of("")) == 1.0 and P.likeness(of(""), of("a")) == 0.0
