"""From raw documents to token ids: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. Repeated doc_ids, nulls and extra columns of any name do no harm; an empty table passes through
as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import bpe, jaccard, mixing, quality, secrets
from braidwork.llm.common import materialize, packed, table, unpacked

#: A source may be used up to so many times on average; every document is used at least once.
MAX_REPETITION = 1.25
#: Removed rows up to which their list is sent to every executor; beyond, it is joined by shuffle.
SENT_ROWS = 100_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; n_chars is told anew.

    Null and empty texts have no words and go; repeated rows are judged each by itself, so all stay or all go.
    """
    judged = quality.clean(docs).where("kept")
    new = {"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text")}
    return judged.select([new.get(c, F.col("doc").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that of the smallest
    doc_id, nulls last, the first row of equals. Null and wordless texts are equal to each other.

    Rows are numbered once, in a written table that all later jobs read: however tasks are dealt, a number means one row.
    """
    own = materialize(docs.select(packed(docs, "doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    told = own.select(F.col("doc").getField("doc_id").alias("doc_id"), F.col("doc").getField("text").alias("text"), "row")
    of = materialize(jaccard.near_duplicates(told, key="row", keep=("doc_id",)), "groups")
    stays = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row"))
    gone = materialize(of.select("row").join(stays, "row", "left_anti"), "gone")
    gone = F.broadcast(gone) if gone.limit(SENT_ROWS + 1).count() <= SENT_ROWS else gone
    return unpacked(own.join(gone, "row", "left_anti"), "doc")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows and null texts too, with masks in place of secrets and n_chars told anew where any is."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again as their weight asks, up to MAX_REPETITION times on average.

    Null is a source like any other; texts without words follow their block; rows of equal doc_id and source share a fate.
    """
    return mixing.remixed(docs, max_repetition=MAX_REPETITION)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 and ids for every row; null and empty texts have no ids."""
    return bpe.encode_texts(docs, keep=("doc_id", "source"))


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: SimHash fingerprints and BPE merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
