"""Games to standings: validation, two-sided sums, ratios and ranking, in batch; the stream uses the same functions."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = "Both homeTeam and awayTeam are required."
SELF = "A team cannot play against itself."
UNKNOWN = "Unknown team supplied."
SCORES = "Scores must be non-negative integers."
TIE = "Baseball games cannot end in a tie."


def checked(games: DataFrame, teams: DataFrame) -> DataFrame:
    """games with home and away (long scores, null if not whole), winner and error: the first rule broken, or null.

    games: game_id, home_team, away_team, home_score, away_score (any type), played_at; teams: name, unique.
    """
    known = teams.select(F.collect_set("name").alias("_names"))  # a league, not a table that grows with the games
    score = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    whole = lambda c: (F.floor(score(c)) == score(c)) & (score(c) >= 0)
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    names = F.col("_names")
    error = (
        F.when(blank("home_team") | blank("away_team"), REQUIRED)
        .when(F.col("home_team") == F.col("away_team"), SELF)
        .when(~F.array_contains(names, F.col("home_team")) | ~F.array_contains(names, F.col("away_team")), UNKNOWN)
        .when(~F.coalesce(whole("home_score") & whole("away_score"), F.lit(False)), SCORES)
        .when(score("home_score") == score("away_score"), TIE)
    )
    good = games.crossJoin(F.broadcast(known)).withColumn("error", error)
    long = lambda c: F.when(F.coalesce(whole(c), F.lit(False)), score(c)).cast("long")
    winner = F.when(F.col("error").isNull(), F.when(score("home_score") > score("away_score"), F.col("home_team")).otherwise(F.col("away_team")))
    return good.withColumns({"home": long("home_score"), "away": long("away_score"), "winner": winner}).drop("_names")


def sides(valid: DataFrame) -> DataFrame:
    """Two rows a game, one for each team: name, won, runs_for, runs_against."""
    side = lambda team, mine, theirs: F.struct(F.col(team).alias("name"), (F.col(mine) > F.col(theirs)).cast("long").alias("won"), F.col(mine).alias("runs_for"), F.col(theirs).alias("runs_against"))
    return valid.select(F.explode(F.array(side("home_team", "home", "away"), side("away_team", "away", "home"))).alias("s")).select("s.*")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.sum("won").alias("wins"), F.sum(1 - F.col("won")).alias("losses"), F.sum("runs_for").alias("runs_for"), F.sum("runs_against").alias("runs_against"))


def standings(sums: DataFrame, teams: DataFrame) -> DataFrame:
    """Every team with wins, losses, runs, run_diff and pct to 3 places, ranked by rounded pct, run_diff and name."""
    counts = ["wins", "losses", "runs_for", "runs_against"]
    all_ = teams.select("name").join(sums, "name", "left").na.fill(0, counts)
    played = F.col("wins") + F.col("losses")
    pct = F.when(played == 0, F.lit(0.0)).otherwise(F.round(F.col("wins") / F.when(played == 0, 1).otherwise(played), 3))
    return all_.withColumns({"run_diff": F.col("runs_for") - F.col("runs_against"), "pct": pct}).orderBy(F.desc("pct"), F.desc("run_diff"), F.lower("name"), "name")


def league(games: DataFrame, teams: DataFrame) -> DataFrame:
    return standings(totals(sides(checked(games, teams).where("error IS NULL"))), teams)


def newest(games: DataFrame, n: int | None = None) -> DataFrame:
    out = games.orderBy(F.desc("played_at"), F.desc("game_id"))
    return out if n is None else out.limit(n)


def recorded(game: dict, games: DataFrame, teams: DataFrame, now: int, game_id: int | None = None) -> tuple[int, dict]:
    """(201, the game) or (400, the error) for one posted game; the caller appends a good one to the table.

    The number is the caller's, or drawn at random from 63 bits, so that no two posts share one and no table is counted.
    """
    spark = games.sparkSession
    number = uuid.uuid4().int >> 65 if game_id is None else game_id
    row = spark.createDataFrame([(number, *(None if game.get(k) is None else str(game[k]) for k in ("home_team", "away_team", "home_score", "away_score")), now)], "game_id long, home_team string, away_team string, home_score string, away_score string, played_at long")
    found = checked(row, teams).first()
    if found.error:
        return 400, {"error": found.error}
    return 201, {"id": found.game_id, "home_team": found.home_team, "away_team": found.away_team, "home_score": found.home, "away_score": found.away, "winner": found.winner, "played_at": now}


def posted(games: DataFrame, teams: DataFrame, path: str) -> DataFrame:
    """(game_id, status, error, winner) for each game of a batch; good ones are appended to the table at `path`.

    A game whose number the table already has is answered as before and not appended again, so that a post can be repeated;
    of one number repeated within a batch, all rows are answered and the first by home team, away team and scores is appended.
    """
    spark, told = games.sparkSession, checked(games, teams)
    good = told.where("error IS NULL")
    row = F.struct("home_team", "away_team", "home_score", "away_score", "played_at")
    new = good.groupBy("game_id").agg(F.min(row).alias("g")).select("game_id", "g.*")
    try:
        new = new.join(spark.read.parquet(path).select("game_id"), "game_id", "left_anti")
    except AnalysisException:
        pass  # no game was posted yet
    new.write.mode("append").parquet(path)
    return told.select("game_id", F.when(F.col("error").isNull(), 201).otherwise(400).alias("status"), "error", "winner")
