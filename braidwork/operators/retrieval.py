"""Keyword and vector search over tables: batches of queries are rows, results are ranked rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.geometry import cosine
from ..functions.text import tokens
from ..shared import sent, written
from .nearest import matrix_of as vectors

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, KEYWORD_WEIGHT, KEYWORD_FLOOR = 60, 0.35, 2.0
#: Queries that are sent to every task at once; more are asked in blocks of about so many, a scan of the table each.
QUERY_BLOCK = 20_000
#: Pairs of a query and a document that a task scores, about.
TASK_PAIRS = 2_000_000
#: Queries and rows that meet in one matrix product.
TILE, ROWS = 256, 4096


def pool_size(k: int) -> int:
    return max(4 * k, 20)


def ranked(scored: DataFrame, query: str, score: str, k: int, *ties: Column | str) -> DataFrame:
    """The k best rows of each query with rank from 1. Only k rows of a query leave each task."""
    w = Window.partitionBy(query).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_index(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings: term, doc, tf; lengths: doc, dl; terms: term, idf). Rare terms weigh ln((N - n + .5) / (n + .5)); where
    that is negative, EPSILON times the mean weight of all terms."""
    postings, lengths = bm25_postings(docs, doc, text)
    return postings, lengths, bm25_terms(postings, lengths)


def word_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(term, doc, tf, dl), with a row of the empty term and no occurrences for a document without words; dl: all its words.

    Documents are dealt by number first: a text moves once, all its words are counted where they are split, and a table in
    one file is split by all tasks. Rows of one number are one document.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(doc, text).repartition(parts, doc).groupBy(doc).agg(tokens(F.array_join(F.collect_list(text), " ")).alias("_t"))
    words = whole.select(doc, F.size("_t").cast("long").alias("dl"), F.explode_outer("_t").alias("term"))
    return words.groupBy(doc, "dl", F.coalesce("term", F.lit("")).alias("term")).agg(F.count("term").alias("tf")).select("term", doc, "tf", "dl")


def bm25_postings(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    return _parted(word_counts(docs, doc, text), doc)


def _parted(every: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    return every.where("term <> ''").select("term", doc, "tf"), every.groupBy(doc).agg(F.sum("tf").alias("dl"))


def bm25_terms(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    return term_weights(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), lengths.agg(F.count(F.lit(1)).alias("n")))


def term_weights(found: DataFrame, n: DataFrame) -> DataFrame:
    """(term, idf) of the terms found (term, df) in n documents, a table of one row."""
    raw = found.crossJoin(F.broadcast(n)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    return raw.crossJoin(F.broadcast(floor)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, query: str, text: str, doc: str) -> DataFrame:
    """(query, doc, score) for documents with a query term; a word said twice in a query counts twice.

    Scores are rounded to 9 places, so that equal documents tie in whatever order their parts are summed.
    """
    postings, lengths, terms = index
    asked = queries.select(query, F.explode(tokens(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qf"))
    asked = written(asked.join(terms, "term").select(query, "term", (F.col("qf") * F.col("idf")).alias("weight")))
    mean = lengths.agg(F.avg("dl").alias("avgdl"))
    # Only postings of the terms asked for move, once, to their document's task, where all its terms and queries meet.
    spark = postings.sparkSession
    pairs = lengths.count() * asked.select(query).distinct().count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    held = postings.select("term", doc, "tf").join(sent(asked.select("term").distinct()), "term", "left_semi").repartition(parts, doc).join(lengths, doc)
    tf = F.col("tf")
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = held.crossJoin(F.broadcast(mean)).select("term", doc, part.alias("_part")).join(sent(asked), "term")
    return hit.groupBy(query, doc).agg(F.round(F.sum(F.col("weight") * F.col("_part")), 9).alias("score"))


def bm25_topk(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, query: str, text: str, doc: str, k: int) -> DataFrame:
    return ranked(bm25_scores(index, queries, query, text, doc), query, "score", k, doc)


def _blocks(queries: DataFrame, query: str, size: int) -> list[DataFrame]:
    n = queries.limit(size + 1).count()
    if n <= size:
        return [queries]
    blocks = -(-queries.count() * 2 // size)  # twice as many as fit, so that none is over-full by chance
    return [queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == i) for i in range(blocks)]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def vector_topk_pairs(table: DataFrame, queries: DataFrame, query: str, q_vec: str, doc: str, vec: str, k: int, exclude_self: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """As vector_topk, by expressions over pairs; for few queries, without Python workers."""

    def one(asked: DataFrame) -> DataFrame:
        pairs = table.select(doc, vec).crossJoin(F.broadcast(asked.select(query, F.col(q_vec).alias("_q"))))
        pairs = pairs.where(F.col(query) != F.col(doc)) if exclude_self else pairs
        return ranked(pairs.select(query, doc, cosine(F.col(vec), F.col("_q")).alias("score")), query, "score", k, doc)

    return _all([one(b) for b in _blocks(queries, query, block)])


def _leading(row: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, by score and then by name, rows in order."""
    order = np.lexsort((np.unique(name, return_inverse=True)[1].ravel(), -score, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], score[order[kept]], name[order[kept]]


def vector_topk(table: DataFrame, queries: DataFrame, query: str, q_vec: str, doc: str, vec: str, k: int, exclude_self: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows of unit vectors by cosine, exactly: (query, doc, score, rank).

    A block of queries, its size checked, goes to every task. Batches of rows are held against TILE queries at a time in a
    matrix product, and of each query a task keeps the k best so far: what it holds doesn't grow with the table, nor, but for
    the block and those, with the queries. Rows are dealt over all cores first, whatever files they lie in.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *table.schema.fields]}
    more, context = k + exclude_self, table.sparkSession.sparkContext
    dealt = table.select(doc, F.col(vec).cast("array<double>").alias(vec)).repartition(max(2, context.defaultParallelism), doc)

    def one(part: DataFrame) -> DataFrame:
        asked = part.select(query, F.col(q_vec).cast("array<double>").alias(q_vec)).toArrow()
        held = context.broadcast((asked.column(0).combine_chunks(), vectors(asked.column(1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            tiles = range(0, len(ids), TILE)
            best = {at: None for at in tiles}
            for batch in batches:
                for cut in range(0, batch.num_rows if len(ids) else 0, ROWS):
                    piece = batch.slice(cut, ROWS)
                    names, own = piece.column(0).to_numpy(zero_copy_only=False), vectors(piece.column(1))
                    for at in tiles:
                        best[at] = _nearer(best[at], matrix[at : at + TILE] @ own.T, names, more)
            for at, found in best.items():
                if found is not None:
                    row, score, name = found
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + at)), pa.array(name, kind), pa.array(score)], [query, doc, "score"])

        kind = to_arrow_type(table.schema[doc].dataType)
        best = dealt.mapInArrow(run, f"`{query}` {kinds[query]}, `{doc}` {kinds[doc]}, score double")
        return ranked(best.where(F.col(query) != F.col(doc)) if exclude_self else best, query, "score", k, doc)

    return _all([one(b) for b in _blocks(queries, query, block)])


def _nearer(best: tuple[np.ndarray, np.ndarray, np.ndarray] | None, scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (row, score, name) of each row of scores, those found before included.

    Only what may be among the k best is rounded and sorted: scores of the k-th best known or more, less what rounding moves.
    """
    if best is not None and len(best[0]) == k * len(scores):
        floor = best[1].reshape(-1, k)[:, -1]
    elif scores.shape[1] >= k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        floor = np.full(len(scores), -np.inf)
    row, at = np.nonzero(~(scores < floor[:, None] - 1e-11))
    # Products of equal vectors can differ in the last places by where they lie in a matrix; rounded, they tie.
    new = (row, np.round(scores[row, at], 12), names[at])
    return _leading(*(new if best is None else (np.concatenate(x) for x in zip(best, new, strict=True))), k)


#: The matrix form was once apart from the main one.
vector_topk_blas = vector_topk


def fused(vector: DataFrame, keyword: DataFrame, query: str, doc: str, k: int, keyword_weight: float = KEYWORD_WEIGHT, floor: float = KEYWORD_FLOOR) -> DataFrame:
    """Weighted reciprocal rank fusion of two rankings: (query, doc, score, rank).

    Keyword rows under the floor go before ranks are given. Of equal scores, vector hits come first, then by rank.
    """
    kept = keyword.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc)))
    list_ = lambda df, weight, nr: df.select(query, doc, (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"), F.lit(nr).alias("nr"), F.col("rank").alias("r"))
    both = list_(vector, 1.0, 0).unionByName(list_(kept, keyword_weight, 1))
    summed = both.groupBy(query, doc).agg(F.sum("part").alias("score"), F.min(F.struct("nr", "r")).alias("first"))
    return ranked(summed, query, "score", k, F.col("first")["nr"], F.col("first")["r"], doc).drop("first")


def hybrid(table: DataFrame, queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], query: str, text: str, q_vec: str, doc: str, vec: str, k: int, use_keywords: bool = True) -> DataFrame:
    pool = pool_size(k)
    near = vector_topk(table, queries.where(F.col(q_vec).isNotNull()), query, q_vec, doc, vec, pool)
    if not use_keywords:
        return near.where(F.col("rank") <= k)
    return fused(near, bm25_topk(index, queries, query, text, doc, pool), query, doc, k)


def rerank(hits: DataFrame, query: str, doc: str, q_text: str, text: str, k: int, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """hits scored anew by `scorer` over batches of pairs, and the k best of each query; equal scores stay in the order of
    their ranks, if they have any, then of doc."""

    @F.pandas_udf("double")
    def score(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), d.tolist()), dtype=float)

    was = F.col("rank") if "rank" in hits.columns else F.lit(None).cast("int")
    own = hits.withColumn("_was", was).drop("rank").withColumn("rerank_score", score(F.col(q_text), F.col(text)))
    return ranked(own, query, "rerank_score", k, "_was", doc).drop("_was")


def expand_parents(hits: DataFrame, chunks: DataFrame, query: str, doc: str, k: int, parent: str = "parent_id", parent_text: str = "parent_text", text: str = "text") -> DataFrame:
    """The first hit of each parent in rank order, up to k, with the parent's text in place of the hit's, which is kept as child_text."""
    own = hits.join(chunks.select(doc, parent, parent_text, F.col(text).alias("child_text")), doc, "left")
    own = own.withColumn("_p", F.coalesce(F.col(parent), F.col(doc).cast("string")))
    first = own.withColumn("_f", F.row_number().over(Window.partitionBy(query, "_p").orderBy("rank"))).where("_f = 1").drop("_f")
    again = first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).where(F.col("rank") <= k)
    return again.withColumn("text", F.coalesce(F.col(parent_text), "child_text")).drop("_p")


def best_score(hits: DataFrame, queries: DataFrame, query: str, score: str = "score", none: float = 0.0) -> DataFrame:
    """(query, score): each query's best, `none` for a query without hits."""
    return queries.select(query).join(hits.groupBy(query).agg(F.max(score).alias("score")), query, "left").na.fill(none, ["score"])


def build_index(docs: DataFrame, doc: str, text: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index as tables under `path`, read back: one copy of the postings, from which lengths and weights come.

    Documents without words are kept by the empty term, which no query has.
    """
    spark = docs.sparkSession
    word_counts(docs, doc, text).write.mode("overwrite").parquet(f"{path}/all")
    every = spark.read.parquet(f"{path}/all")
    postings, lengths = every.where("term <> ''"), every.groupBy(doc).agg(F.first("dl").alias("dl"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    bm25_terms(postings, lengths).write.mode("overwrite").parquet(f"{path}/terms")
    return postings, lengths, spark.read.parquet(f"{path}/terms")


def write_index(index: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    for df, name in zip(index, ("postings", "lengths", "terms"), strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms"))
