"""Retrieval measures: ranks of expected sources, recall, reciprocal rank, separation of classes, thresholds, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of a question and a chunk that one task of a sweep scores at most.
SCORED = 1_000_000


def source_matches(title: Column, expected: Column) -> Column:
    """Whether any expected string is part of the title, whatever the case."""
    return F.exists(expected, lambda e: F.contains(F.lower(title), F.lower(e)))


def hit_ranks(questions: DataFrame, results: DataFrame, query: str, good: Column, *keep: str) -> DataFrame:
    """(query, keep..., rank, top_score): the first good result's rank, null for a miss; every question has a row."""
    joined = questions.join(results, query, "left")
    return joined.groupBy(query, *keep).agg(F.min(F.when(good, F.col("rank"))).alias("rank"), F.max("score").alias("top_score"))


def recall(ranks: DataFrame, k: int, *group: str) -> DataFrame:
    """recall_1, recall_3, recall_k and mrr over all questions; a miss adds 0."""
    at = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0))
    return ranks.groupBy(*group).agg(at(1).alias("recall_1"), at(3).alias("recall_3"), at(k).alias("recall_k"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n"))


def separation(scores: DataFrame, inside: str = "inside", score: str = "score") -> DataFrame:
    """One row: least and mean score inside, largest and mean outside, their gap, and a threshold half-way if there is a gap."""
    s, i = F.col(score), F.col(inside)
    agg = scores.agg(F.min(F.when(i, s)).alias("ic_min"), F.avg(F.when(i, s)).alias("ic_mean"), F.max(F.when(~i, s)).alias("ooc_max"), F.avg(F.when(~i, s)).alias("ooc_mean"))
    gap = F.col("ic_min") - F.col("ooc_max")
    return agg.withColumn("gap", gap).withColumn("suggested_threshold", F.when(gap > 0, F.round((F.col("ic_min") + F.col("ooc_max")) / 2, 3)))


def overlap_rows(scores: DataFrame, inside: str = "inside", score: str = "score") -> DataFrame:
    """Rows inside under the largest outside score, and rows outside over the least inside score."""
    ends = separation(scores, inside, score).select("ic_min", "ooc_max")
    s, i = F.col(score), F.col(inside)
    return scores.crossJoin(F.broadcast(ends)).where((i & (s < F.col("ooc_max"))) | (~i & (s > F.col("ic_min")))).drop("ic_min", "ooc_max")


def boundary_rows(scores: DataFrame, n: int = 5, inside: str = "inside", score: str = "score", key: str = "id") -> DataFrame:
    """The n lowest inside and the n highest outside."""
    low = scores.where(F.col(inside)).orderBy(score, key).limit(n)
    return low.unionByName(scores.where(~F.col(inside)).orderBy(F.desc(score), key).limit(n))


def threshold_sweep(scores: DataFrame, inside: str = "inside", score: str = "score", steps: int = 24) -> DataFrame:
    """For steps + 1 thresholds from the least to the largest score (a span of 1 if all are equal): rows handled well."""
    ends = scores.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    span = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    grid = ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(F.col("lo") + span * i / steps, 3))).alias("threshold"))
    s, i, t = F.col(score), F.col(inside), F.col("threshold")
    agg = scores.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(
        F.count_if(i & (s >= t)).alias("ic_answered"), F.count_if(i).alias("ic_total"), F.count_if(~i & (s < t)).alias("ooc_abstained"), F.count_if(~i).alias("ooc_total")
    )
    return agg.withColumn("accuracy", (F.col("ic_answered") + F.col("ooc_abstained")) / (F.col("ic_total") + F.col("ooc_total")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first of the most accurate."""
    return sweep.orderBy(F.desc("accuracy"), "threshold").limit(1)


def metric_delta(a: DataFrame, b: DataFrame, names: tuple[str, ...] = ("recall_1", "recall_3", "recall_k", "mrr")) -> DataFrame:
    """One row of a's measures less b's, both of one row."""
    left, right = a.select(*(F.col(n).alias(f"a_{n}") for n in names)), b.select(*(F.col(n).alias(f"b_{n}") for n in names))
    return left.crossJoin(F.broadcast(right)).select(*((F.col(f"a_{n}") - F.col(f"b_{n}")).alias(f"d_{n}") for n in names))


def grid(sizes: list[int], overlaps: list[int], spark) -> DataFrame:
    """All pairs with an overlap under the size."""
    s, o = spark.createDataFrame([(x,) for x in sizes], "size int"), spark.createDataFrame([(x,) for x in overlaps], "overlap int")
    return s.crossJoin(F.broadcast(o)).where("overlap < size")


def grid_rank(measured: DataFrame, *by: str, noise: float = 0.06) -> DataFrame:
    """Combinations ranked by their measures, with the spread of the first measure and whether it is within noise."""
    order = Window.orderBy(*(F.desc(c) for c in by[:2]), *by[2:])
    spread = F.max(by[0]).over(Window.partitionBy()) - F.min(by[0]).over(Window.partitionBy())
    return measured.withColumn("place", F.row_number().over(order)).withColumn("spread", spread).withColumn("is_noise", F.col("spread") < noise)


def behaviour(rows: DataFrame, answered: str = "answered", expected: str = "expected") -> DataFrame:
    """(accuracy, n): the share of rows whose answering is as expected."""
    return rows.agg(F.avg((F.col(answered) == F.col(expected)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def chunk_sweep(sentences: DataFrame, questions: DataFrame, combinations: DataFrame, part: list[str], order: str, k: int = 5, title: str = "title") -> DataFrame:
    """Recall of keyword search over chunks of every combination (size, overlap), all in one pass over the sentences.

    sentences: part, order, ts, sentence, title; questions: id, q, expect_sources; the combinations are few. Chunks,
    postings and weights all carry their combination as a key.
    """
    from ..functions.text import tokens
    from ..shared import sent, written
    from . import retrieval as R
    from . import transcripts as T

    combo = ["size", "overlap"]
    sizes = [tuple(r) for r in combinations.select(*combo).distinct().collect()]
    made = T.swept_chunks(sentences.select(*part, title, order, "ts", "sentence"), [*part, title], order, sizes)
    chunks = made.select(*combo, title, F.concat_ws("::", *(F.col(p).cast("string") for p in part), "chunk_index").alias("id"), tokens(F.col("text")).alias("_t"))
    chunks = written(chunks)
    # Chunks are dealt once; their postings and all that is scored of them stay in their tasks, whose number grows with what is scored.
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(max(parts, -(-chunks.count() * questions.count() // SCORED)), *combo, "id")
    posted = dealt.select(*combo, "id", title, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(*combo, "id", title, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    totals = chunks.groupBy(*combo).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("avgdl"))
    raw = written(posted.groupBy(*combo, "term").agg(F.count(F.lit(1)).alias("df")).join(totals, combo).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.groupBy(*combo).agg((F.avg("raw") * R.EPSILON).alias("floor"))
    weights = raw.join(mean, combo).select(*combo, "term", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    asked = questions.select(F.col("id").alias("q_id"), F.explode(tokens(F.col("q"))).alias("term")).groupBy("q_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    hits = posted.join(sent(written(asked.join(weights, "term"))), [*combo, "term"])
    score = F.col("qf") * F.col("idf") * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(*combo, "q_id", "id", title).agg(F.round(F.sum(score), 9).alias("score"))
    w = Window.partitionBy(*combo, "q_id").orderBy(F.desc("score"), "id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    every = combinations.select(*combo).crossJoin(F.broadcast(questions.select(F.col("id").alias("q_id"), "expect_sources")))
    joined = every.join(best, [*combo, "q_id"], "left")
    ranks = joined.groupBy(*combo, "q_id").agg(F.min(F.when(source_matches(F.col(title), F.col("expect_sources")), F.col("rank"))).alias("rank"))
    return recall(ranks, k, *combo)
