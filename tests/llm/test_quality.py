import random
import re
from collections import Counter

from pyspark.sql import functions as F

from braidwork.llm import quality as Q

SPACE = " \t\n\x0b\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def line_fails(line):
    solid = re.sub(r"[\x20\x09-\x0D]+", "", line)
    if not solid:
        return False
    low = line.lower()
    return (
        len(re.findall(r"[#*$%&|<>!?^~=_{}\\]", line)) > 0.15 * len(solid)
        or not any(c.isalpha() or c.isnumeric() for c in line)
        or bool(re.search(r"^[^|»›•·]{0,40}([|»›•·][^|»›•·]{0,40}){2,}$", line))
        or any(p in low for p in Q.BOILERPLATE.split("|"))
    )


EDGES = ["", None, " \n\t ", "one", "a b c d e " * 2, "a b c d e f a b c d e", "x " * 40, "\n\n", "a\nb\na\n a", "no break space é 😀 " * 3, "w " * 20_000, "p q r s t u v w x y z\n" * 3]


def test_against_brute_force(docs_of):
    random.seed(10)
    vocab = ["a", "bb", "the", "é", "##", "$5", "|", "end.", "x"]
    texts = EDGES + ["".join(random.choice(vocab) + random.choice([" ", " ", " ", "\n", "\t", "\r\n"]) for _ in range(random.randint(0, 80))) for _ in range(150)]
    rows = {r["doc"].doc_id: r for r in Q.clean(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.q_words, r.q_word_chars, r.q_symbols, r.q_dup_lines, r.q_repeat_words, r.base_failed) == brute(t or ""), t
        assert r.cleaned_text == "\n".join(x for x in (t or "").split("\n") if not line_fails(x))
        assert r.kept == (not r.base_failed and r.q_lost <= 0.5)
        assert not (r.kept and r.base_failed)


def prose(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(n)]


def test_lines_go_and_documents_that_lose_too_much(docs_of):
    line = " ".join(prose(12, 1)) + "."
    other = " ".join(prose(12, 2)) + "."
    menu, legal = "Home | About | Contact | Help", "Copyright © 2020 All rights reserved"
    junk = "\n".join(" ".join(w + "###" for w in prose(8, k)) for k in range(20, 25))
    texts = [f"{line}\n{menu}\n{other}", f"{line}\n{junk}", f"{line}\n\n{legal}\n{other}", line + " " + other]
    rows = {r["doc"].doc_id: r for r in Q.clean(docs_of(texts)).collect()}
    assert rows[0].cleaned_text == f"{line}\n{other}" and rows[0].kept
    assert not rows[1].kept and rows[1].q_lost > 0.5 and not rows[1].base_failed
    assert rows[2].cleaned_text == f"{line}\n\n{other}" and rows[2].kept
    assert rows[3].cleaned_text == texts[3] and rows[3].q_lost == 0


def test_filters_stay_above_the_rules(docs_of):
    assert Q.clean(docs_of(["a b"] * 3 + [" ".join(prose(30, 3))])).where("kept AND q_words > 5").count() == 1


def test_clashing_columns_and_empty_table(docs_of):
    docs = docs_of(["x y"]).withColumn("kept", F.lit(7)).withColumn("_t", F.lit("z")).withColumn("q_words", F.lit(None))
    row = Q.clean(docs).first()
    assert row["doc"].kept == 7 and row["doc"]._t == "z" and row.q_words == 2
    assert Q.clean(docs_of([])).count() == 0


def test_a_mention_does_not_cost_a_long_line(docs_of):
    phrases = Q.BOILERPLATE.split("|")
    long = [" ".join(prose(40, 50 + i) + [p] + prose(40, 80 + i)) for i, p in enumerate(phrases)]
    short = [" ".join(prose(30, 110 + i)) + f"\n{p}" for i, p in enumerate(phrases)]
    rows = {r["doc"].doc_id: r for r in Q.clean(docs_of(long + short)).collect()}
    assert all(rows[i].kept and rows[i].cleaned_text == t for i, t in enumerate(long))
    assert all(rows[len(long) + i].cleaned_text == t.split("\n")[0] for i, t in enumerate(short))
