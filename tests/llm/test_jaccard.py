import random

import corpus_pipeline
from braidwork.llm import jaccard as J


def jaccard(a, b):
    a, b = (set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_leave_the_pipeline(spark, docs_of, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=6))
    base = [[word() for _ in range(200)] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base:
        near, far = list(w), list(w)
        for at in (20, 80, 140, 190):
            near[at] = word()
        for at in range(5, 200, 20):
            far[at] = word()
        texts += [" ".join(near), " ".join(far)]
    like = [jaccard(texts[i], texts[40 + 2 * i]) for i in range(40)]
    assert min(like) > 0.8 and max(jaccard(texts[i], texts[41 + 2 * i]) for i in range(40)) < 0.7
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(texts), str(tmp_path)).collect()}
    assert kept == {*range(40), *range(41, 120, 2)}


def test_components_against_brute_force(docs_of):
    """A large cluster of copies with few to many edits, chains of copies, and unrelated texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=6))
    base = [word() for _ in range(150)]
    texts = []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(0, 9)):
            own[at] = word()
        texts.append(" ".join(own))
    chain = [word() for _ in range(200)]
    for i in range(12):
        chain = [*chain[:-8], *(word() for _ in range(8))] if i % 2 else [*(word() for _ in range(8)), *chain[8:]]
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(50)) for _ in range(40)] + ["", None, " ", "a b", "a b", texts[0]]
    docs = docs_of(texts)
    sets = [set(J.shingles(t or "").tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert len(set(root[:150])) > 3
    assert {r.doc_id: r.component_id for r in J.near_duplicates(docs).collect()} == dict(enumerate(root))


def test_fingerprints_are_linked_by_the_covering_code(spark, docs_of, tmp_path, monkeypatch):
    """Near fingerprints are found whatever the bands say, and the pipeline's stage asks for them."""
    rng = random.Random(8)
    prints = [rng.getrandbits(63) for _ in range(60)]
    prints += [p ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for p in prints[:30]] + [p ^ 7 for p in prints[:10]] + prints[:5]
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node long, fp long")
    least = {p: min(i for i, q in enumerate(prints) if q == p) for p in prints}
    wanted = {(least[p], i) for i, p in enumerate(prints) if least[p] != i}
    wanted |= {tuple(sorted((least[p], least[q]))) for p in prints for q in prints if 0 < (p ^ q).bit_count() <= 2}
    assert {tuple(sorted(r)) for r in J._near_prints(nodes, 2).collect()} == wanted
    asked = []
    monkeypatch.setattr(J, "links", lambda p, t: asked.append((p.count(), t)) or J_LINKS(p, t))
    text = [rng.choice("abcdefghij") * rng.randint(2, 9) for _ in range(400)]
    near = [*text[:-1], "zzz"]
    corpus_pipeline.drop_near_duplicates(spark, docs_of([" ".join(text), " ".join(near), "a b c d e f"]), str(tmp_path)).collect()
    assert asked == [(3, 2)]


J_LINKS = getattr(J, "links", None)


def test_texts_and_sets_are_not_shuffled_to_be_looked_up(spark, docs_of, monkeypatch):
    """Few documents are looked at whole: the others' texts and sets stay where they are, however large a small table is."""
    rng = random.Random(11)
    base = [" ".join("".join(rng.choices("etaoin", k=5)) for _ in range(60)) for _ in range(12)]
    docs = docs_of([*base, *(t + " more" for t in base[:6])])
    plans, write = {}, J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, label: plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc_id: r.component_id for r in J.near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {i: i % 12 for i in range(18)}
    assert not [p for label in ("sets", "asked") for p in plans[label] if "Exchange hashpartitioning" in p]
