import hashlib
import random
import re

import regex
from pyspark.sql import functions as F

from braidwork.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def told(spans):
    return [(s.start, s.nr, s.end, s.kind) for s in spans]


EDGES = [
    "", None, "token: abc", "secret=token:abcdefgh", "token=password=abcdef", "api_key = 'abc123xyz'", 'APIKEY":"zzzzzz', "tokKen=abcdefg", "paſsword=abcdefg",
    "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 14, "xAKIA" + "0" * 30, "a" * 24, "a" * 23, "é😀" + "0f" * 12 + "g" + "1" * 30, "token = \"" + "7c" * 20 + '"', "password=secret=1234567",
]


def test_base_against_brute_force(docs_of):
    random.seed(3)
    bits = ["token", "secret", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCD0123", "0123456789abcdef", "é", "😀", "-", "\n", "passwd", "xyz"]
    texts = EDGES + ["".join(random.choices(bits, k=random.randint(1, 60))) for _ in range(300)] + ["token=abcdef1 " * 1500]
    rows = {r.doc_id: r for r in secrets.scan(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t or "")
        assert told(rows[i].base) == want, t
        assert set(want) <= set(told(rows[i].spans))


def test_weak_parts_need_their_complements(docs_of):
    strong, weak, bare = "login: alice_w", "Zk9Qm2Lx8Vb4Tn6Rw1Yp", "https://db.example.com/x"
    near, far = "some words between ", "filler " * 60
    texts = [
        f"{strong} {near}{weak} {near}{bare}",
        f"{strong} {near}{weak}",
        f"{strong} {near}{bare}",
        f"{strong} {far}{weak} {far}{bare}",
        f"{strong} {near}token={'ab12' * 10}",
        f"{weak} and nothing else",
    ]
    rows = {r.doc_id: {s.kind for s in r.spans} for r in secrets.scan(docs_of(texts)).collect()}
    assert rows[0] == {"part_id", "part_secret", "part_endpoint"}
    assert rows[1] == rows[2] == rows[3] == rows[5] == set()
    assert rows[4] == {"part_id", "assign", "hex"}


def test_redaction(docs_of):
    texts = ["keep me", None, "", "a token = \"" + "ab" * 20 + '" b', "é " + "0" * 30 + " z " + "f" * 24, "a token = \"" + "ab" * 20 + '" b']
    docs = docs_of(texts).withColumn("extra", F.lit(1))
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert [out[i].text for i in range(6)] == ["keep me", None, "", 'a [SECRET]" b', "é [SECRET] z [SECRET]", 'a [SECRET]" b']
    assert out[3].n_chars == len(out[3].text) and out[0].extra == 1


def test_query_digest(docs_of):
    text = "x token = \"" + "7c" * 20 + '"'
    row = secrets.scan(docs_of([text])).select(F.sha2(secrets.joined(F.col("base")), 256).alias("h")).first()
    want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(text))
    assert row.h == hashlib.sha256(want.encode()).hexdigest()


def test_empty_table(docs_of):
    assert secrets.scan(docs_of([])).count() == 0
    assert secrets.redact(docs_of([])).count() == 0


def test_scope_is_the_gap_between_parts(docs_of):
    weak, bare = "Zk9Qm2Lx8Vb4Tn6Rw1Yp", "https://db.example.com/x"
    texts = [
        f"login: alice_w {weak * 13} {bare}",
        f"login: alice_w {'a ' * 70}{weak} {'a ' * 70}{bare}",
        f"login: alice_w {weak} {'a ' * 120}{bare}",
    ]
    rows = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(docs_of(texts)).collect()}
    assert rows == {0: ["part_id", "part_secret", "part_endpoint"], 1: ["part_id", "part_secret", "part_endpoint"], 2: []}


def brute_linked(text):
    """Weak parts by joins of all pairs of parts: in the scope of a part whose own scope holds an identifier, a secret and a third part."""
    strong = brute(text)
    weak = []
    for nr, (part, pattern) in enumerate(secrets.WEAK.items()):
        for m in regex.finditer(pattern.replace(r"\x20", " "), text):
            if not any(b[0] < m.end() and m.start() < b[2] for b in strong):
                weak.append((m.start(), nr + len(secrets.KINDS), m.end(), f"part_{part}"))
    parts = strong + weak
    met = lambda a, b: max(a[0], b[0]) - min(a[2], b[2]) <= secrets.SCOPE
    centres = []
    for a in parts:
        kinds = {b[3] for b in parts if met(a, b)}
        if kinds & {"access", "part_id"} and kinds & {"assign", "hex", "part_secret"} and kinds & {*secrets.KINDS, "part_endpoint"}:
            centres.append(a)
    return sorted(strong + [w for w in weak if any(met(w, c) for c in centres)])


def test_scopes_do_not_chain(docs_of):
    """Sixty ordinary addresses between an identifier and a secret 10,000 code points away link nothing."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8)))
    link = lambda: f"https://{word()}.example.com/{word()} " + " ".join(word() for _ in range(20)) + " "
    chain = "".join(link() for _ in range(60))
    texts = [f"username: alice {chain}Zk9Qm2Lx8Vb4Tn6Rw1Yp", f"username: alice Zk9Qm2Lx8Vb4Tn6Rw1Yp {chain}", chain + "login: bob_1 " + chain]
    rows = {r.doc_id: told(r.spans) for r in secrets.scan(docs_of(texts)).collect()}
    assert len(texts[0]) > 6000 and rows[0] == rows[2] == []
    assert rows[1] == brute_linked(texts[1]) and 3 <= len(rows[1]) <= 6 and max(s[2] for s in rows[1]) < 600
    assert {r.doc_id: r.text for r in secrets.redact(docs_of(texts)).collect()}[0] == texts[0]
    many = []
    for _ in range(60):
        parts = [link, lambda: f"login: {word()} ", lambda: "Zk9Qm2Lx8Vb4Tn6Rw1Yp ", lambda: "token=abcdef1 ", lambda: word() + " " * rng.randint(1, 150)]
        many.append("".join(rng.choices(parts, [6, 1, 1, 0.3, 3], k=1)[0]() for _ in range(rng.randint(5, 60))))
    rows = {r.doc_id: told(r.spans) for r in secrets.scan(docs_of(many)).collect()}
    for i, text in enumerate(many):
        assert rows[i] == brute_linked(text), text
    assert 0 < sum(len(r) > len(brute(t)) for r, t in zip(rows.values(), many, strict=True)) < 60


def planted(rng):
    """(text, places of the weak parts of its credentials): credentials, lone parts and prose."""
    prose = lambda n: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(n))
    random_string = lambda: "".join(rng.choices("ABCDEFGHJKLMNP", k=8) + rng.choices("abcdefghjkmnp", k=8) + rng.choices("23456789", k=8))
    out, want = prose(5) + " ", []
    for _ in range(rng.randint(1, 4)):
        parts = [f"login: {prose(1)}_{rng.randint(10, 99)}", random_string(), f"https://{prose(1)}.example.com/{prose(1)}"]
        rng.shuffle(parts)
        whole = rng.random() < 0.5
        for p in parts if whole else parts[:2] if "login" in parts[2] or rng.random() < 0.3 else parts[:1]:
            if whole:
                want.append((len(out), len(out) + len(p)))
            out += p + " " + prose(rng.randint(0, 6)) + " "
        out += prose(90) + " "
    return out, want


def test_linked_parts_against_all_pairs_and_planted_credentials(docs_of):
    rng = random.Random(12)
    made = [planted(rng) for _ in range(120)]
    rows = {r.doc_id: told(r.spans) for r in secrets.scan(docs_of([t for t, _ in made])).collect()}
    caught = wanted = right = reported = 0
    for i, (text, want) in enumerate(made):
        assert rows[i] == brute_linked(text), text
        own = {(s, e) for s, _, e, k in rows[i] if k.startswith("part_")}
        caught, wanted, right, reported = caught + len(own & set(want)), wanted + len(want), right + len(own & set(want)), reported + len(own)
    assert wanted > 150 and caught >= 0.95 * wanted and right >= 0.95 * reported


def test_redaction_when_cores_change(spark, tmp_path):
    """Rows are masked by themselves: a scan cut up otherwise between two readings changes nothing."""
    key = 'token = "' + "7c" * 20 + '"'
    rows = [(i, f"row {i} " + key * (i % 50 == 0), "en", "s", 1) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(9).write.parquet(str(tmp_path / "docs"))
    seen = []
    for bytes_ in ("4k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        out = secrets.redact(spark.read.parquet(str(tmp_path / "docs")))
        seen.append((out.where("text like '%7c7c%'").count(), out.where("text like '%[SECRET]%'").count(), out.count()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen == [(0, 80, 4000)] * 2


def test_odd_columns_and_many_finds(spark):
    text = ("token=abcdef1 login: alice_w2 " + "Zk9Qm2Lx8Vb4Tn6Rw1Yp ") * 3000
    rows = [(1, text, 5, "x", 2), (1, text, 5, "x", 2), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "`a.b` int, text string, base int, _doc string, spans int")
    out = secrets.redact(docs).collect()
    assert len(out) == 3 and out[0].asDict().keys() == {"a.b", "text", "base", "_doc", "spans"}
    assert sorted((r.text or "").count("[SECRET]") for r in out) == [0, 9000, 9000]
    got = secrets.scan(docs, ("a.b", "_doc")).collect()
    assert sorted(len(r.spans) for r in got) == [0, 9000, 9000]
