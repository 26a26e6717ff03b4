import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from braidwork.llm import ranks, snapshots

COLUMNS = ("text", "lang", "source")
SCHEMA = "doc_id long, text string, lang string, source string"


def later(rows):
    out = []
    for k, t, l, s in rows:  # noqa: E741
        r = 24 if k is None else zlib.crc32(str(k).encode()) % 25
        new = {1: (k, (t or "") + "+", l, s), 2: (k, t, s, l), 3: (-1 - k if k is not None else None, t, l, s), 4: (-1 - k if k is not None else None, t, l, None)}.get(r, (k, t, l, s))
        out += [] if r == 0 else [new] if r != 5 else [new, (-1 - k, t, l, s)]
    return out


def brute(a, b):
    """Pairs by key for unique keys, then by content."""
    digest = lambda r: hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()
    differ = lambda x, y: ",".join(c for c, p, q in zip(COLUMNS, x[1:], y[1:], strict=True) if p != q)
    old, new = {r[0]: r for r in a}, {r[0]: r for r in b}
    assert len(old) == len(a) and len(new) == len(b)
    out = [(k, k, "update" if differ(old[k], r) else "same", differ(old[k], r), digest(r)) for k, r in new.items() if k in old]
    groups = defaultdict(lambda: ([], []))
    for rows, other, side in ((old, new, 0), (new, old, 1)):
        for k, r in rows.items():
            if k not in other:
                groups[r[1:3]][side].append(r)
    low = lambda r: (r[0] is not None, r[0] or 0)
    for x, y in groups.values():
        x, y = sorted(x, key=low), sorted(y, key=low, reverse=True)
        out += [(q[0], p[0], "rekey", differ(p, q), digest(q)) for p, q in zip(x, y, strict=False)]
        out += [(p[0], p[0], "delete", "", None) for p in x[len(y) :]] + [(q[0], None, "insert", "", digest(q)) for q in y[len(x) :]]
    return sorted(out, key=str)


def found(spark, a, b):
    before, after = (spark.createDataFrame(r, SCHEMA) for r in (a, b))
    after = after.withColumn("row_sha256", F.sha2(F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in COLUMNS)), 256))
    return sorted((tuple(r) for r in snapshots.difference(before, after, "doc_id", COLUMNS, ("text", "lang"), carry=("row_sha256",)).collect()), key=str)


def table(n, seed, hot):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "same", "same", f"text {rng.randint(0, 30)}"]) if not hot or i % 3 else "hot", rng.choice([None, "", "en", "de"]) if not hot else "en", rng.choice([None, "s1", "s2"])) for i in range(n)]


@pytest.mark.parametrize(("n", "seed", "hot"), [(400, 1, False), (900, 2, True), (1, 3, False), (0, 4, False)])
def test_against_brute_force(spark, n, seed, hot):
    a = table(n, seed, hot)
    b = later(a)
    got = spark.createDataFrame(a, SCHEMA)
    assert sorted(map(tuple, snapshots.later_snapshot(got).collect()), key=str) == sorted(b, key=str)
    assert found(spark, a, b) == brute(a, b)


def test_null_key_and_unrelated_snapshots(spark):
    a = [(None, "x", "en", "s"), (1, "y", "en", "s"), (2, "z" * 200_000, None, None)]
    b = [(None, "x", "en", "t"), (9, "y", "en", None), (8, "q", None, None)]
    assert found(spark, a, b) == brute(a, b)
    assert {r[2] for r in found(spark, a, [])} == {"delete"} and {r[2] for r in found(spark, [], b)} == {"insert"}


def test_repeated_keys_pair_one_by_one(spark):
    a = [(7, "x", "en", "s")] * 50 + [(7, "y", "en", "s")] + [(1, "q", "en", "s")]
    b = [(7, "x", "en", "s")] * 48 + [(7, "y", "en", "s")] + [(1, "q", "en", "s")]
    got = found(spark, a, b)
    assert len(got) == 52 and sum(r[2] == "delete" for r in got) == 2 and sum(r[2] in ("same", "update") for r in got) == 50


def test_odd_columns_and_ranks(spark):
    df = spark.createDataFrame([(i % 3, i, "v") for i in range(300)] + [(None, None, None)] * 4, "`a.b` int, `k k` int, d0 string")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd-ranks")
    for down in (False, True):
        rows = ranks.ranked(spark.read.parquet(path), ["a.b"], ["k k"], descending=down).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["a.b"]].append((r.nr, r["k k"]))
        assert len(rows) == 304 and all([n for n, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in by.values())
        assert all([k for _, k in sorted(by[g])] == sorted((k for _, k in by[g]), reverse=down) for g in range(3))
    other = df.where("`k k` < 200 OR `k k` IS NULL")
    ops = snapshots.difference(df, other, "k k", ("d0", "a.b"), ("d0",), carry=("a.b",)).groupBy("op").count().collect()
    assert dict(map(tuple, ops)) == {"same": 204, "delete": 100}
