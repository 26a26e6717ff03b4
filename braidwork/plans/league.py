"""Queries on games and standings, in batch and as streams, and on sources that write and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import standings as S
from ..sources import files as X
from ..streaming import live as L
from .common import events, r6, shared, table

TEAMS = ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf")


def _teams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TEAMS], "name string")


def _games(spark: SparkSession, d: str) -> DataFrame:
    """Games out of orders; some break a rule: a team against itself, an unknown one, a tie, a negative score."""
    team = lambda c: F.get(F.array(*map(F.lit, (*TEAMS[:6], "nobody"))), (c % 7).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("game_id"), team(F.col("o_custkey")).alias("home_team"), team(F.floor(F.col("o_custkey") / 7) + F.col("o_orderkey")).alias("away_team"),
        (F.col("o_orderkey") % 11 - F.when(F.col("o_orderkey") % 97 == 0, 20).otherwise(0)).cast("string").alias("home_score"), (F.col("o_custkey") % 9).cast("string").alias("away_score"), (F.col("o_orderkey") % 1000).cast("long").alias("played_at"),
    )


def standings(spark: SparkSession, d: str) -> DataFrame:
    return S.league(_games(spark, d), _teams(spark))


def checked_games(spark: SparkSession, d: str) -> DataFrame:
    return S.checked(_games(spark, d), _teams(spark)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def recent_games(spark: SparkSession, d: str) -> DataFrame:
    """The twenty newest games: a listing of that length."""
    return S.newest(_games(spark, d).select("game_id", "home_team", "away_team", "played_at"), 20)


def posted_games(spark: SparkSession, d: str) -> DataFrame:
    """The answers to all games, posted in two batches of which the second comes twice, with how many games of each the table
    holds afterwards."""
    at, own = shared(spark), _games(spark, d)
    late = F.col("played_at") >= 500
    answers = S.posted(own.where(~late), _teams(spark), at)
    for _ in range(2):
        second = S.posted(own.where(late), _teams(spark), at)
    held = spark.read.parquet(at).groupBy("game_id").agg(F.count(F.lit(1)).alias("held"))
    return answers.unionByName(second).join(held, "game_id", "left").na.fill(0, ["held"])


def stream_standings(spark: SparkSession, d: str) -> DataFrame:
    """The ranking that the stream over the same games ends with."""
    at = shared(spark)
    _games(spark, d).write.parquet(f"{at}/games")
    source = spark.readStream.schema(_games(spark, d).schema).parquet(f"{at}/games")
    L.write_standings(source, _teams(spark), f"{at}/standings", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/standings")


def keyed_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orders written by year and read back but for what one key's rewriting replaced."""
    at = shared(spark)
    own = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.year("o_orderdate").cast("string").alias("year"))
    X.write_keyed(own, at, "year")
    X.write_keyed(own.where("year = '1995'").withColumn("o_orderkey", F.lit(-1).cast("long")), at, "year")
    return X.read_keyed(spark, at, "o_orderkey long, year string", "year", ["1995", "1996"]).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = shared(spark)
    own = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    X.write_json_array(own, f"{at}/array")
    X.write_jsonl(own, f"{at}/lines")
    ddl = "n_nationkey long, n_name string"
    return X.read_json_array(spark, f"{at}/array", ddl).unionByName(X.read_jsonl(spark, f"{at}/lines", ddl)).groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = shared(spark)
    own = table(spark, d, "events").select("user_id", "event_id", "value")
    X.write_csv(own, at)
    return X.read_csv(spark, at, "user_id long, event_id long, value double").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


def media_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.get(F.array(*map(F.lit, (".MP4", ".txt", ".mov", ".ts.bak"))), (F.col("p_partkey") % 4).cast("int")))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).where(X.is_media(F.col("name")))


QUERIES = {f.__name__: f for f in (standings, checked_games, recent_games, posted_games, stream_standings, keyed_tables, json_round_trip, csv_round_trip, media_names)}

_T = ", ".join(f"'{t}'" for t in TEAMS[:6])
_G = f"""(SELECT o_orderkey AS game_id, [{_T}, 'nobody'][o_custkey % 7 + 1] AS h, [{_T}, 'nobody'][(o_custkey // 7 + o_orderkey) % 7 + 1] AS a, o_orderkey % 11 - CASE WHEN o_orderkey % 97 = 0 THEN 20 ELSE 0 END AS hs, o_custkey % 9 AS "as", CAST(o_orderkey % 1000 AS BIGINT) AS played_at FROM orders)"""
_ERR = f"CASE WHEN h = a THEN '{S.SELF}' WHEN h = 'nobody' OR a = 'nobody' THEN '{S.UNKNOWN}' WHEN hs < 0 THEN '{S.SCORES}' WHEN hs = \"as\" THEN '{S.TIE}' END"
_STAND = f"""WITH g AS (SELECT * FROM {_G} WHERE {_ERR} IS NULL), s AS (SELECT h AS name, hs > "as" AS won, hs AS f, "as" AS a FROM g UNION ALL SELECT a, "as" > hs, "as", hs FROM g),
  t AS (SELECT name, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, sum(f) AS runs_for, sum(a) AS runs_against FROM s GROUP BY 1)
  SELECT n.name, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, CAST(coalesce(runs_for, 0) AS BIGINT) AS runs_for, CAST(coalesce(runs_against, 0) AS BIGINT) AS runs_against, CAST(coalesce(runs_for - runs_against, 0) AS BIGINT) AS run_diff,
  coalesce(round(wins / (wins + losses), 3), 0.0) AS pct FROM (SELECT unnest([{_T}, 'golf']) AS name) n LEFT JOIN t USING (name)"""

ORACLE = {
    "standings": _STAND,
    "stream_standings": _STAND,
    "checked_games": f"SELECT {_ERR} AS error, count(*) AS n FROM {_G} GROUP BY 1",
    "posted_games": f"SELECT game_id, CASE WHEN err IS NULL THEN 201 ELSE 400 END AS status, err AS error, CASE WHEN err IS NULL THEN CASE WHEN hs > \"as\" THEN h ELSE a END END AS winner, CAST(CASE WHEN err IS NULL THEN 1 ELSE 0 END AS BIGINT) AS held FROM (SELECT *, {_ERR} AS err FROM {_G})",
    "recent_games": f"SELECT game_id, h AS home_team, a AS away_team, played_at FROM {_G} ORDER BY played_at DESC, game_id DESC LIMIT 20",
    "stream_sessions": """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 60 MINUTE AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "keyed_tables": "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n, CAST(sum(CASE WHEN year(o_orderdate) = 1995 THEN -1 ELSE o_orderkey END) AS BIGINT) AS keys FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1",
    "json_round_trip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(2 AS BIGINT) AS n FROM nation",
    "csv_round_trip": "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1",
    "media_names": "SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '.MP4' ELSE '.mov' END AS name FROM part WHERE p_partkey % 4 IN (0, 2)",
}
