"""SQL of DuckDB over the rows of one partition, and row numbers within groups of any size, over ranges and prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kind_of, materialize, quoted

#: Rows of a batch that a partition's statement returns.
BATCH = 10_000


def per_partition(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """What a statement of DuckDB gives over the view `rows`, the rows of one partition at a time. Partitions without rows
    give none. A partition is held in memory: it must be dealt so that none is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        with duckdb.connect(config={"threads": 1}) as con:
            con.register("rows", pa.Table.from_batches(held))
            yield from con.sql(sql).to_arrow_reader(BATCH)

    return df.mapInArrow(run, schema)


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], descending: bool = False, out: str = "nr") -> DataFrame:
    """df with `out`: the row's number (long, from 1) in its group by `order`, nulls smallest; rows that are equal in both
    get numbers of their own in any order.

    The rows are dealt by ranges of the group's hash, order and place (bounds that Spark takes from a sample of a million rows at most), so that a group of any size is spread over as many tasks as it
    needs; DuckDB numbers each partition's rows, and to those of a group that goes on from earlier partitions its rows
    there are added. What is added has a row for each partition at most. df must be a written table (it is read twice).
    """
    names = list(df.columns)
    safe = {c: f"c{i}" for i, c in enumerate(names)}  # mapInArrow takes no names with dots
    own, by, along = df.toDF(*safe.values()), [safe[c] for c in group], [safe[c] for c in order]
    sort = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in along]
    dealt = own.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts_of(df), F.xxhash64(*by), *sort, "_place")
    along = ", ".join(f"{c} {'DESC NULLS LAST' if descending else 'ASC NULLS FIRST'}" for c in along)
    sql = f"SELECT {', '.join(safe.values())}, _part, row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {along}, _place) AS _in FROM rows"
    schema = ", ".join(f"{n} {kind_of(df, c)}" for c, n in safe.items()) + ", _part int, _in long"
    placed = materialize(per_partition(dealt.withColumn("_part", F.spark_partition_id()), sql, schema), "placed")
    held = placed.groupBy(*by, "_part").agg(F.max("_in").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = materialize(held.withColumn("_before", before).where("_before > 0"), "earlier-rows").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), "_before")
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = placed.join(earlier.hint("merge"), same, "left")
    return joined.select(*(F.col(n).alias(c) for c, n in safe.items()), (F.col("_in") + F.coalesce("_before", F.lit(0))).alias(out))
