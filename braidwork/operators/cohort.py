"""Cohort percentiles, rate metrics of batted balls, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

SHARES = (0.1, 0.25, 0.5, 0.75, 0.9)


def positions(df: DataFrame, cohort: list[str], value: str) -> DataFrame:
    """(cohort, value, n, before, total): each distinct value of a cohort with its rows, the rows of smaller values, and all
    rows. Nulls are values, and the smallest.

    Equal values are counted before any shuffle. What is left is dealt by ranges of cohort and value, summed up within
    each partition, and told the sums of the partitions before: no cohort is sorted in one task, however large. Sums of
    partitions have at most one row a cohort and partition.
    """
    counts = df.groupBy(*cohort, value).agg(F.count(F.lit(1)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(counts.repartitionByRange(parts, *cohort, F.col(value).asc_nulls_first()).withColumn("_part", F.spark_partition_id()))
    inside = placed.withColumn("_in", F.sum("n").over(Window.partitionBy("_part", *cohort).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)))
    shares = placed.groupBy(*cohort, "_part").agg(F.sum("n").alias("_s"))
    upto = Window.partitionBy(*cohort).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*(F.col(c).alias(f"_{c}") for c in cohort), F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(*cohort)).alias("total"))
    same = F.col("_part") == F.col("_p")
    for c in cohort:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return inside.join(shares, same).select(*cohort, value, "n", (F.coalesce("_in", F.lit(0)) + F.col("_before")).alias("before"), "total")


def percentiles(df: DataFrame, cohort: list[str], value: str) -> DataFrame:
    """(cohort, p10 to p90, n): exact, interpolated between neighbours; nulls left out, cohorts of nulls kept."""
    own = positions(df.where(F.col(value).isNotNull()), cohort, value)
    told = []
    for s in SHARES:
        place = F.lit(s) * (F.col("total") - 1)
        at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value)))
        low, high, place = at(F.floor(place)), at(F.ceil(place)), F.max(place)
        told.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(f"p{round(s * 100)}"))
    found = own.groupBy(*cohort).agg(*told, F.max("total").alias("n"))
    names = [f"p{round(s * 100)}" for s in SHARES]
    every = df.select(*(F.col(c).alias(f"_{c}") for c in cohort)).distinct()
    same = F.lit(True)
    for c in cohort:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return every.join(found, same, "left").select(*(F.col(f"_{c}").alias(c) for c in cohort), *(F.col(n).cast("double").alias(n) for n in names), F.coalesce("n", F.lit(0)).alias("n"))


def percentile_of(df: DataFrame, cohort: list[str], value: str, out: str = "percentile") -> DataFrame:
    """The share of the cohort at or below each row's value."""
    own = positions(df, cohort, value).select(*(F.col(c).alias(f"_{c}") for c in (*cohort, value)), ((F.col("before") + F.col("n")) / F.col("total")).alias(out))
    same = F.lit(True)
    for c in (*cohort, value):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(own, same).drop(*(f"_{c}" for c in (*cohort, value)))


def squared_up(exit_speed: Column, bat_speed: Column, pitch_speed: Column) -> Column:
    return exit_speed / (bat_speed + 0.2 * pitch_speed) >= 0.8


def ball_type(angle: Column) -> Column:
    return F.when(angle < 10, "ground_ball").when(angle < 25, "line_drive").when(angle < 50, "fly_ball").otherwise("popup")


def rates(df: DataFrame, part: list[str], bat: str, exit_: str, pitch: str, angle: str) -> DataFrame:
    """fast_swing, squared_up, blast, hard_hit and sweet_spot rates, and the mean adjusted exit speed."""
    rate = lambda c: F.avg(c.cast("double"))
    fast, sq = F.col(bat) >= 75, squared_up(F.col(exit_), F.col(bat), F.col(pitch))
    return df.groupBy(*part).agg(rate(fast).alias("fast_swing_rate"), rate(sq).alias("squared_up_rate"), rate(fast & sq).alias("blast_rate"), rate(F.col(exit_) >= 95).alias("hard_hit_rate"), rate(F.col(angle).between(8, 32)).alias("sweet_spot_rate"), F.avg(F.greatest(F.col(exit_), F.lit(88.0))).alias("adjusted_exit"))


def mean_of_top(df: DataFrame, part: list[str], value: str, share: float, out: str) -> DataFrame:
    """Mean of the highest `share` of values, at least one: 0.5 for the hardest half, 0.9 for competitive swings."""
    own = positions(df.where(F.col(value).isNotNull()), part, value)
    wanted = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(share) + 1e-9))
    taken = F.greatest(F.lit(0), F.least("n", wanted - (F.col("total") - F.col("before") - F.col("n"))))
    return own.groupBy(*part).agg((F.sum(F.col(value) * taken) / F.sum(taken)).alias(out))


def stratified_sample(df: DataFrame, stratum: Column, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum without replacement, by a keyed digest: the same rows for the same seed on any cluster."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("stratum", stratum).withColumn("_rn", F.row_number().over(Window.partitionBy("stratum").orderBy(order, key))).where(F.col("_rn") <= n).drop("_rn")


def split_by_key(df: DataFrame, key: str, share: float = 0.15, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(training, validation) by a digest of the key, so that no key is in both; rows without a key are trained on."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    held = F.coalesce(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000 < int(share * 10_000), F.lit(False))
    return df.where(~held), df.where(held)


def around(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """Distinct (part, order) of every row and its neighbours one before and one after, none below 0."""
    return df.select(*part, F.explode(F.array(F.col(order) - 1, F.col(order), F.col(order) + 1)).alias(order)).where(F.col(order) >= 0).distinct()
