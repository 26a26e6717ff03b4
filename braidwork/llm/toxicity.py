"""Toxicity by class-conditional Kneser-Ney models of the characters in words.

Each class (toxic, ordinary) has a model of order ORDER over the characters of its documents' words, boundaries included,
each word counted once a document. The longest grams count as they occur, shorter ones by how many characters they follow;
contexts of up to SHARED - 1 characters are counted over both classes together, and every class backs off to these shared
counts, so that rare expressions are judged by their pieces and unseen ones hardly at all. A word's evidence is the
difference of its log-likelihoods under the two models; a document's is that difference a character, with how many of its
words stand out and how far. A logistic fit on labelled documents that the models have not seen turns this into a score.

Texts are read once. Each task codes its documents in chunks of CHUNK_CHARS characters: a chunk is one row that holds its
distinct words and, for each document, the words' places and counts. The distinct words of a longer text are dealt to
chunks of its own, a word to one of them, so that no chunk grows with a text. The counts are exact and grow with the corpus: each
chunk tells its distinct grams once, with their counts in training documents; these are summed by gram, and shorter grams
follow order by order in tables of the shared folder. A gram's chances go back to the chunks that asked for it, where
words and documents are summed in whole numbers, and the parts of a document once more by its number. No gram, word or text is gathered, and no text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, kind_of, materialize, table, whole_text

#: Order, marks and decay have the least loss by cross_validated() on the fit's sample; held-out rows had no part in it.
ORDER, SHARED = 4, 2
#: Counts up to this are given to the backoff in full, larger ones by so much: an expression of few documents is rare.
RARE = 2
#: Characters of texts that are coded together; the distinct words of a longer text fill chunks of so many.
CHUNK_CHARS = 1 << 24
#: Parts of a nat in which evidence is summed, as whole numbers: sums are then equal in any order.
PARTS = 10**9
#: Labelled keys, at most, on which the logistic fit is made; the documented bound on its sample.
FIT_ROWS = 20_000
THRESHOLD = 0.3
BEGIN, END = "\x02", "\x03"
#: Evidence, in nats, from which a word stands out.
MARKS = (1.0, 2.0, 3.0)
#: The weight of the logistic fit's quadratic penalty.
DECAY = 1.0
N_FEATURES = 3 + 2 * len(MARKS)
NAMES = [f"f{i}" for i in range(N_FEATURES)]
#: What is told of a document's words: sums of evidence, of characters and of words, the largest evidence, words over each mark.
SUMS = ["gain", "chars", "n", "top", *(f"over{i}" for i in range(len(MARKS)))]


def part_of(key: Column) -> Column:
    """0 to 3: rows of 2 are held out, a bounded sample of 3 fits the scores, all others train the models."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def _packed(values: list[np.ndarray]) -> bytes:
    """Whole numbers below 2^32, their bytes sorted by weight and compressed."""
    flat = np.concatenate(values).astype("<u4") if values else np.zeros(0, "<u4")
    return zstandard.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(plain.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _dealt(text: str, most: int) -> Iterator[dict[str, int]]:
    """A long text's distinct words with their counts, in parts of `most` characters or one word; no list of all its words."""
    part, chars = {}, 0
    for w, n in Counter(m.group() for m in re.finditer(r"\S+", text.lower())).items():
        if part and chars + len(w) > most:
            yield part
            part, chars = {}, 0
        part[w] = n
        chars += len(w)
    yield part


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, docs, keys, words, sizes, steps, counts), one row for each chunk of documents, written once.

    docs: numbers of the documents, one for each row read; a text beyond CHUNK_CHARS is in several chunks, which share none
    of its words. words: the chunk's distinct words, each ended by a line feed. For each document, sizes has the number of
    its distinct words; steps has their places among the chunk's words in rising order, each as the step from the one
    before; counts has how often each occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, doc = TaskContext.get().partitionId() << 32, 0, 0
        places: defaultdict = defaultdict()

        def fresh() -> None:
            nonlocal places, own, keys, sizes, steps, counts, chars
            places = defaultdict()
            places.default_factory = places.__len__
            own, keys, sizes, steps, counts, chars = [], [], [], [], [], 0

        def add(k: object, at: np.ndarray, n: np.ndarray) -> None:
            own.append(task + doc)
            keys.append(k)
            sizes.append(len(at))
            steps.append(np.diff(at, prepend=0))
            counts.append(n)

        def told() -> pa.RecordBatch:
            nonlocal number
            words = zstandard.compress("".join(w + "\n" for w in places).encode(), 3)
            packed = [pa.array([x], pa.binary()) for x in (words, _packed([np.array(sizes)]), _packed(steps), _packed(counts))]
            made = pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), pa.array([own], pa.list_(pa.int64())), pa.array([keys], pa.list_(keys_kind)), *packed], ["chunk", "docs", "keys", "words", "sizes", "steps", "counts"])
            number += 1
            fresh()
            return made

        own, keys, sizes, steps, counts, chars = [], [], [], [], [], 0
        fresh()
        for batch in batches:
            keys_kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(t) > CHUNK_CHARS:
                    if keys:
                        yield told()
                    for part in _dealt(t, CHUNK_CHARS):
                        add(k, np.fromiter(map(places.__getitem__, part), np.int64), np.fromiter(part.values(), np.int64))
                        yield told()
                else:
                    add(k, *np.unique(np.fromiter(map(places.__getitem__, t.lower().split()), np.int64), return_counts=True))
                    chars += len(t)
                    if chars >= CHUNK_CHARS:
                        yield told()
                doc += 1
        if keys:
            yield told()

    schema = f"chunk long, docs array<long>, keys array<{kind_of(docs, key)}>, words binary, sizes binary, steps binary, counts binary"
    return materialize(docs.select(column(docs, key).alias("key"), whole_text(text).alias("_text")).mapInArrow(run, schema), "chunks")


def _words(row: dict) -> list[str]:
    return zstandard.decompress(row["words"]).decode().split("\n")[:-1]


def _places(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first of each document's places, places); places are those of the words that each document has."""
    sizes, steps = _unpacked(row["sizes"]), _unpacked(row["steps"])
    first = np.cumsum(sizes) - sizes
    upto = np.concatenate([[0], np.cumsum(steps)])
    return first, upto[1:] - np.repeat(upto[first], sizes)


def _grams_of(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct grams, each word's grams by number, how many each word has): for each character of a word and its end,
    it with the up to ORDER - 1 characters before it."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    found, sizes = [], []
    for w in words:
        w = BEGIN + w + END
        found += [known[w[:e]] for e in range(2, min(ORDER, len(w) + 1))]
        found += [known[w[e : e + ORDER]] for e in range(len(w) - ORDER + 1)]
        sizes.append(len(w) - 1)
    return list(known), np.array(found, np.int64), np.array(sizes, np.int64)


def asked(coded: DataFrame, trained: DataFrame) -> DataFrame:
    """(chunk, gram, n0, n1): each chunk's distinct grams, and in how many ordinary and toxic training documents' words
    of the chunk they occur. trained: (key, toxic) of the training documents, keys unique."""
    roles = coded.select("chunk", F.posexplode("keys").alias("at", "key")).join(trained, "key").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "toxic"))).alias("roles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words = _words(row)
                first, places = _places(row)
                ends = np.append(first[1:], len(places))
                n = np.zeros((2, len(words)), np.int64)
                for r in row["roles"] or []:
                    n[r["toxic"], places[first[r["at"]] : ends[r["at"]]]] += 1
                grams, at, sizes = _grams_of(words)
                sums = [np.bincount(at, np.repeat(x, sizes), len(grams)).astype(np.int64) if len(at) else np.zeros(0, np.int64) for x in n]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), row["chunk"])), pa.array(grams, pa.string()), *map(pa.array, sums)], ["chunk", "gram", "n0", "n1"])

    rows = coded.select("chunk", "words", "sizes", "steps").join(roles, "chunk", "left")
    return materialize(rows.mapInArrow(run, "chunk long, gram string, n0 long, n1 long"), "asked")


def chances(counts: DataFrame) -> list[DataFrame]:
    """For k = 1 to ORDER, (gram, p0, p1): how likely either model holds the last character of a gram after the others.

    counts: (gram, n0, n1), grams distinct, of ORDER characters or fewer where they begin a word; chances are told for all
    of them, counted or not, and for all ends of those.
    """
    levels = [materialize(counts.where(F.length("gram") == ORDER), "grams")]
    for k in range(ORDER - 1, 0, -1):
        ends = levels[-1].select(F.substring("gram", 2, k).alias("gram"), (F.col("n0") > 0).cast("long").alias("n0"), (F.col("n1") > 0).cast("long").alias("n1"))
        every = ends.union(counts.where(F.length("gram") == k))
        levels.append(materialize(every.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams"))
    out: list[DataFrame] = []
    both = F.col("n0") + F.col("n1")
    for k, own in enumerate(levels[::-1], 1):
        around, p = Window.partitionBy("context"), []
        own = own.withColumn("context", F.substring("gram", 1, k - 1))
        if k <= SHARED:
            ones, twos = own.agg(F.count_if(both == 1), F.count_if(both == 2)).first()
            off = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            sums = {"total": F.sum(both), "mass": F.sum((both > 0).cast("long"))}
        else:
            sums = {f"{name}{c}": F.sum(F.least(f"n{c}", F.lit(RARE)) if name == "mass" else f"n{c}") for name in ("total", "mass") for c in (0, 1)}
        if k == 1:
            own = own.crossJoin(own.agg(*(v.alias(n) for n, v in sums.items()))).withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            own = own.select("gram", "n0", "n1", *(v.over(around).alias(n) for n, v in sums.items()), F.substring("gram", 2, k - 1).alias("rest"))
            own = own.join(out[-1].toDF("rest", "q0", "q1"), "rest")
        for c in (0, 1):
            count, total, less, mass = (both, F.col("total"), off, off * F.col("mass")) if k <= SHARED else (F.col(f"n{c}"), F.col(f"total{c}"), RARE, F.col(f"mass{c}"))
            below = F.greatest(count - less, F.lit(0)) + mass * F.col(f"q{c}")
            p.append(F.when(total > 0, below / total).otherwise(F.col(f"q{c}")).alias(f"p{c}"))
        out.append(materialize(own.select("gram", *p), "chances"))
    return out


def gains(wanted: DataFrame) -> DataFrame:
    """(gram, gain) for the grams of asked(): log-likelihood under toxic less that under ordinary, in PARTS of a nat."""
    counts = materialize(wanted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "counts")
    told = chances(counts)
    every = told[1]
    for p in told[2:]:
        every = every.union(p)
    log = lambda p: F.log(F.greatest(F.col(p), F.lit(1e-12)))
    # Below ORDER characters, only beginnings are asked for.
    own = every.where((F.length("gram") == ORDER) | F.col("gram").startswith(BEGIN))
    return own.select("gram", F.round((log("p1") - log("p0")) * PARTS).cast("long").alias("gain"))


def word_gains(words: list[str], known: dict[str, int]) -> np.ndarray:
    """The evidence of each word, in PARTS of a nat; known has the gains of all their grams."""
    grams, at, sizes = _grams_of(words)
    own = np.array([known[g] for g in grams], np.int64)
    return np.add.reduceat(own[at], np.cumsum(sizes) - sizes) if words else np.zeros(0, np.int64)


def sums_of(row: dict, known: dict[str, int]) -> np.ndarray:
    """A row of SUMS for each document of a chunk; all zero for one without words."""
    words = _words(row)
    first, places = _places(row)
    n = _unpacked(row["counts"])
    out = np.zeros((len(first), len(SUMS)), np.int64)
    some = np.flatnonzero(np.append(first[1:], len(places)) > first)
    if not len(some):
        return out
    gain, size = word_gains(words, known)[places], np.array([len(w) + 1 for w in words], np.int64)[places]
    told = [np.add.reduceat(x, first[some]) for x in (gain * n, size * n, n)] + [np.maximum.reduceat(gain, first[some])]
    told += [np.add.reduceat((gain > mark * PARTS) * n, first[some]) for mark in MARKS]
    out[some] = np.stack(told, 1)
    return out


def features() -> list[Column]:
    """N_FEATURES columns from SUMS: evidence a character, the largest, words, and how many words stand out and what share."""
    n, some = F.col("n"), F.col("n") > 0
    out = [10 * (F.col("gain") / PARTS) / F.col("chars"), F.col("top") / (4 * PARTS), F.log1p(n.cast("double"))]
    for i in range(len(MARKS)):
        over = F.col(f"over{i}")
        out += [F.log1p(over.cast("double")), 10 * F.sqrt(over / n)]
    return [F.when(some, c).otherwise(F.lit(0.0)).alias(name) for name, c in zip(NAMES, out, strict=True)]


def described(coded: DataFrame, wanted: DataFrame, told: DataFrame) -> DataFrame:
    """(key, f0, f1, ...) for every document of the chunks: each chunk meets the gains of the grams that it asked for, and
    what is told of a document's parts is put together by its number."""
    near = wanted.select("chunk", "gram").join(told, "gram")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right["gram"].to_pylist(), right["gain"].to_pylist(), strict=True))
        out = [(row["docs"], row["keys"], sums_of(row, known)) for i in range(left.num_rows) for row in left.slice(i, 1).to_pylist()]
        docs, keys = ([x for o in out for x in o[i]] for i in (0, 1))
        found = np.concatenate([o[2] for o in out] or [np.zeros((0, len(SUMS)), np.int64)])
        return pa.table([pa.array(docs, pa.int64()), pa.array(keys, left.schema.field("keys").type.value_type), *map(pa.array, found.T.copy())], ["doc", "key", *SUMS])

    schema = f"doc long, key {coded.schema['keys'].dataType.elementType.simpleString()}, " + ", ".join(f"{n} long" for n in SUMS)
    parts = coded.groupBy("chunk").cogroup(near.groupBy("chunk")).applyInArrow(run, schema)
    whole = parts.groupBy("doc").agg(F.first("key").alias("key"), *((F.max if c == "top" else F.sum)(c).alias(c) for c in SUMS))
    return materialize(whole.select("key", *features()), "features")


def logistic(x: np.ndarray, y: np.ndarray, decay: float = DECAY, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic fit, the bias last, by Newton steps on standardised columns with a quadratic penalty."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    if y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(x.shape[1]), math.log(share / (1 - share)))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], decay), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step if np.abs(step).max() < 5 else 5 * step / np.abs(step).max()
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def cross_validated(x: np.ndarray, y: np.ndarray, decay: float = DECAY, folds: int = 10) -> float:
    """Mean logarithmic loss, a row, of fits that have not seen the row; how orders, marks and decay are to be compared, on
    the fit's sample alone. Row i is in fold i mod `folds`."""
    at, p = np.arange(len(y)) % folds, np.zeros(len(y))
    for f in range(folds):
        w = logistic(x[at != f], y[at != f], decay)
        p[at == f] = 1 / (1 + np.exp(-np.clip(x[at == f] @ w[:-1] + w[-1], -30, 30)))
    return float(-np.log(np.where(y > 0, p, 1 - p)).mean())


def shares(labels: DataFrame, key: str = "doc_id", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(trained, sample), both (key, toxic) with unique keys, from rows of labels (key, toxic) outside the held-out part.

    sample: at most fit_rows keys of part 3, chosen by hash; trained: all others. A key labelled twice is toxic if either
    label is; null keys and null labels are left out.
    """
    known = labels.select(column(labels, key).alias("key"), (column(labels, "toxic") != 0).cast("int").alias("toxic")).where("key IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(part_of(F.col("key")) != 2).groupBy("key").agg(F.max("toxic").alias("toxic")).withColumn("at", F.xxhash64(F.col("key").cast("string")))
    third = part_of(F.col("key")) == 3
    last = known.where(third).select("at").orderBy("at").limit(fit_rows).agg(F.max("at")).first()[0]
    chosen = third & (F.col("at") <= F.lit(last)) if last is not None else F.lit(False)
    return known.where(~chosen).select("key", "toxic"), known.where(chosen).select("key", "toxic")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """key and score (0 to 1) for every row of docs, learnt from those rows of docs that labels (key, toxic) mark.

    Only the text is read for a score. Null texts count as empty, very long ones are worked on in parts; an empty text gets the score of no evidence. Equal texts
    get equal scores, repeated rows and keys keep their rows, null keys too (they have no label). Other columns are not
    read, whatever their names. Without labels every score is one half; an empty table gives an empty one. Counts cover
    every labelled row outside the held-out part and the sample of at most fit_rows keys that the logistic fit is made on.
    """
    trained, sample = shares(labels, key, fit_rows)
    coded = chunks(docs, key, text)
    wanted = asked(coded, trained)
    found = described(coded, wanted, gains(wanted))
    rows = found.join(sample, "key").orderBy(F.xxhash64(F.col("key").cast("string")), "key", *NAMES).limit(fit_rows).toArrow()
    x = np.stack([rows[n].to_numpy() for n in NAMES], 1) if rows.num_rows else np.zeros((0, N_FEATURES))
    weights = logistic(x, rows["toxic"].to_numpy().astype(float) if rows.num_rows else np.zeros(0))
    total = F.lit(float(weights[-1]))
    for n, w in zip(NAMES, weights[:-1], strict=True):
        total = total + F.col(n) * float(w)
    return found.select(F.col("key").alias(key), (1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))))).alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(part_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
