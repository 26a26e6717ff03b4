"""Queries on indexes: inverted lists of vectors, and keyword postings in blocks by impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import nearest as N
from ..operators import retrieval as R
from .common import r6, shared, table
from .corpus import ORACLE as PLAIN


def _vectors(spark: SparkSession, d: str) -> tuple[N.Lists, DataFrame]:
    own = table(spark, d, "embeddings").select("vec_id", "embedding")
    return N.build(own, "vec_id", "embedding", shared(spark)), own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))


def vector_lists(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors by inverted lists, exactly."""
    index, asked = _vectors(spark, d)
    return N.search_exact(index, asked, "q_id", "q_vec", 5).select("q_id", "vec_id", r6("score").alias("score"), "rank")


def vector_probed(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of the nearest lists alone, with each query's recall against all pairs."""
    index, asked = _vectors(spark, d)
    found = N.search(index, asked, "q_id", "q_vec", 5)
    exact = R.vector_topk(index.rows, asked, "q_id", "q_vec", "vec_id", "embedding", 5)
    return found.join(N.recall(found, exact, "q_id", "vec_id").select("q_id", "recall"), "q_id").select("q_id", "vec_id", r6("score").alias("score"), "rank", r6("recall").alias("recall"))


def _blocks(spark: SparkSession, d: str) -> tuple[B.Blocks, DataFrame]:
    return B.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", shared(spark)), table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q"))


def bm25_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search from blocks by impact."""
    index, asked = _blocks(spark, d)
    return B.topk(index, asked, "q_id", "q", "doc_id", 5).select("q_id", "doc_id", r6("score").alias("score"), "rank")


def bm25_read(spark: SparkSession, d: str) -> DataFrame:
    """The postings that each query's terms have, and those it reads."""
    index, asked = _blocks(spark, d)
    return B.read_share(index, asked, "q_id", "q", "doc_id", 5)


QUERIES = {f.__name__: f for f in (vector_lists, vector_probed, bm25_blocks, bm25_read)}
ORACLE = {"vector_lists": PLAIN["vector_topk"], "bm25_blocks": PLAIN["bm25_topk"]}
