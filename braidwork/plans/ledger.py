"""Queries on work by key, on the source of frames and on posted games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as X
from ..sources import frames as P
from ..sources.manifest import Manifest, attempted
from .common import r6, shared, table
from .flows import _parts
from .records import ORACLE as RECORDS
from .records import pose_frames


def _counted(row: dict) -> dict:
    """Words of a text; a text without one is refused."""
    words = (row["text"] or "").split()
    if not words:
        raise ValueError("no words")
    return {"n_words": len(words)}


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents twice, told apart by their lengths: some come late, some change, some are gone from the second, some
    have no words in the first or in both."""
    docs, n = table(spark, d, "documents").select("doc_id", "text"), F.coalesce(F.length("text"), F.lit(0))
    first = docs.select("doc_id", F.when(~(n % 7).isin(3, 4), F.col("text")).alias("text"), (n % 7).alias("_kind"))
    second = docs.select("doc_id", F.when(n % 7 == 2, F.concat("text", F.lit(" more"))).when(n % 7 != 4, F.col("text")).alias("text"), (n % 7).alias("_kind"))
    return first.where("_kind <> 1").drop("_kind"), second.where("_kind <> 0").drop("_kind")


def manifest_updates(spark: SparkSession, d: str) -> DataFrame:
    """Every key with its state after two deliveries, the second stopped before its commit and repeated, and its words."""
    held = Manifest(spark, shared(spark), "doc_id")
    work = lambda rows: attempted(rows, "doc_id", _counted, "n_words long")
    first, second = _deliveries(spark, d)
    held.update(first, work)

    def stop() -> None:
        raise InterruptedError

    try:
        held.update(second, work, before_commit=stop)
    except InterruptedError:
        held.update(second, work)
    return held.entries().drop("digest").join(held.results().select("doc_id", "n_words"), "doc_id", "left")


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("video", "frame", "track_id", "keypoint", r6("bbox_x2").alias("bbox_x2"), r6("x").alias("x"), r6("y").alias("y"), "confidence")


def pose_source(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints from files of frames, by the source."""
    at = shared(spark)
    X.write_jsonl(pose_frames(spark, d), at)
    P.register(spark)
    return _told(spark.read.format(P.FORMAT).load(at))


def pose_source_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from three deliveries, by a stream that goes on from its checkpoint after each."""
    at = shared(spark)
    P.register(spark)
    for i, part in enumerate(_parts(pose_frames(spark, d), "frame")):
        X.write_jsonl(part, f"{at}/in/{i:06d}")
        source = spark.readStream.format(P.FORMAT).load(f"{at}/in")
        source.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(once=True).start().awaitTermination()
    return _told(spark.read.schema(source.schema).parquet(f"{at}/out"))


QUERIES = {f.__name__: f for f in (manifest_updates, pose_source, pose_source_stream)}
_BLANK = r"(text IS NULL OR regexp_matches(text, '^\s*$'))"
ORACLE = {
    "manifest_updates": rf"""WITH k AS (SELECT doc_id, text, coalesce(length(text), 0) % 7 AS kind FROM documents),
      e AS (SELECT *, CASE WHEN kind = 0 THEN 'removed' WHEN kind = 4 OR ({_BLANK} AND kind <> 2) THEN 'failed' ELSE 'done' END AS status, CASE WHEN kind IN (0, 1, 2, 3, 4) OR {_BLANK} THEN 1 ELSE 0 END AS generation FROM k)
      SELECT doc_id, status, CASE WHEN status = 'failed' THEN 'ValueError: no words' END AS error, CAST(generation AS BIGINT) AS generation, CASE WHEN status = 'done' THEN CAST(len(regexp_extract_all(text, '\S+')) + CASE WHEN kind = 2 THEN 1 ELSE 0 END AS BIGINT) END AS n_words FROM e""",
    "pose_source": RECORDS["pose_points"],
    "pose_source_stream": RECORDS["pose_points"],
}
