"""Queries that run as streams: files come in deliveries, and the stream is stopped and started again from its checkpoint
after each, so that state, watermarks and batch numbers must outlive it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager, suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import live as L
from .common import events, r6, shared
from .league import ORACLE as LEAGUE
from .series import ORACLE as SERIES

DELIVERIES = 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession, provider: str):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _parts(df: DataFrame, order: str) -> list[DataFrame]:
    """The table in DELIVERIES consecutive ranges of `order`."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return [df]
    cut = lambda i: low + (high - low + 1) * i // DELIVERIES
    return [df.where((F.col(order) >= cut(i)) & (F.col(order) < cut(i + 1))) for i in range(DELIVERIES)]


def _delivered(spark: SparkSession, parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream has written after all deliveries, each row of a batch once."""
    at = shared(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema(parts[0].schema).parquet(f"{at}/in")
        out = stream(source)
        out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def stream_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments by gap or change over a stream, numbered on from delivery to delivery."""
    own = events(spark, d).select("user_id", "event_id", "event_type")
    return _delivered(spark, _parts(own, "event_id"), lambda s: L.segment_stream(s, "user_id", "event_id", "event_type", 300)).select("user_id", "event_id", "segment_id")


def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter's predictions over a stream, whose state goes on from delivery to delivery."""
    seen = F.col("event_id") % 4 != 0
    own = events(spark, d).select("user_id", "event_id", F.when(seen, F.col("value")).alias("cx"), F.when(seen, F.col("value") * 0.5).alias("cy"), F.lit(80.0).alias("w"), F.lit(80.0).alias("h"))
    made = _delivered(spark, _parts(own, "event_id"), lambda s: L.fill_stream(s, "user_id", "event_id"))
    return made.select("user_id", "event_id", *(r6(c).alias(c) for c in ("k_cx", "k_cy", "k_w", "k_h")))


def _closing(own: DataFrame, key: str, ts: str) -> DataFrame:
    """A row of nobody, far ahead: the watermark passes all that went before."""
    return own.limit(1).withColumns({key: F.lit(-1).cast(own.schema[key].dataType), ts: F.lit("2200-01-01 00:00:00").cast(own.schema[ts].dataType)})


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by a gap of an hour, told once each when the watermark has passed them. Rows come in deliveries by
    time; before the last, the first delivery's first rows come again, too late, and are dropped."""
    own = events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    parts = [p.drop("at") for p in _parts(own, "at")]
    parts += [_closing(parts[0], "user_id", "ts"), parts[0]]
    told = _delivered(spark, parts, lambda s: L.gap_sessions(s, "user_id", "ts", "60 minutes", "0 seconds")).where("user_id <> -1")
    return told.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_closed(spark: SparkSession, d: str) -> DataFrame:
    """Segments by change or by a gap of an hour, each told once, by a later row or by a timer."""
    own = events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    parts = [p.drop("at") for p in _parts(own, "at")]
    with _state_store(spark, ROCKS):
        told = _delivered(spark, [*parts, _closing(parts[0], "user_id", "ts")], lambda s: L.closed_segments(s, "user_id", "ts", "event_id", "event_type", 3_600_000, "0 seconds"))
    return told.where("user_id <> -1").select("user_id", F.col("identity").alias("event_type"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Rows by type, after a stop between the write and the commit of the second delivery's batch, which is then repeated."""
    at, own = shared(spark), events(spark, d).select("user_id", "event_id", "event_type")
    stopped: list[int] = []

    def stop_once(n: int) -> None:
        if n == 1 and not stopped:
            stopped.append(n)
            raise RuntimeError("stopped between write and commit")

    for part in _parts(own, "event_id"):
        part.write.mode("append").parquet(f"{at}/in")
        start = lambda: L.write_by_key(spark.readStream.schema(own.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/state", "event_type", stop_once).awaitTermination()
        with suppress(StreamingQueryException):
            start()
        start()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.sum(F.col("event_id").cast("long")).alias("total"))


QUERIES = {f.__name__: f for f in (stream_segments, stream_filter, stream_sessions, stream_closed, stream_replayed)}
ORACLE = {
    "stream_segments": SERIES["segment_gap_or_change"],
    "stream_filter": SERIES["kalman_fill"],
    "stream_sessions": LEAGUE["stream_sessions"],
    "stream_replayed": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_type",
    "stream_closed": """SELECT user_id, event_type, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, CASE WHEN event_type <> lag(event_type) OVER w OR ts - lag(ts) OVER w > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, event_type, s""",
}
