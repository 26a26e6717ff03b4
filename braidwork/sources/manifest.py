"""Work by key that can be repeated: only changed keys are worked on anew, a failing key keeps its error and stops no other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE, FAILED, REMOVED = "done", "failed", "removed"
REPEATED = "key is repeated"


def attempted(rows: DataFrame, key: str, make: Callable[[dict], dict], ddl: str) -> DataFrame:
    """(key, error, columns of ddl): what `make` returns for each row, a dict; or the text of the exception that it raised."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, error string, {ddl}"
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    told = {"error": None, **make(row)}
                except Exception as e:  # noqa: BLE001
                    told = {"error": f"{type(e).__name__}: {e}"}
                out.append({**told, key: row[key]})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


class Manifest:
    """Results of work by key, and the table of keys: (key, digest, status, error), in generations.

    A generation is what one update has written: results of the keys worked on, then the entries of these keys and of those
    removed. A key's last entry counts, and only results that it points to are read, so an update that stops half-way leaves
    nothing to be seen and is repeated under the same number. Nothing that was written is changed; keys are compared by a
    join on their digests, and unchanged results are neither read nor written.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _read(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{kind}")
        except AnalysisException:
            return None

    def entries(self) -> DataFrame | None:
        """The last entry of each key, removed ones too; None before the first update."""
        every = self._read("entries")
        if every is None:
            return None
        last = F.max_by(F.struct("digest", "status", "error", "generation"), "generation").alias("e")
        return every.groupBy(self.key).agg(last).select(self.key, "e.digest", "e.status", "e.error", F.col("e.generation").cast("long").alias("generation"))

    def results(self) -> DataFrame:
        """The results of all keys done, each from the generation that made them."""
        now = self.entries().where(F.col("status") == DONE).select(self.key, "generation")
        return self._read("results").withColumn("generation", F.col("generation").cast("long")).join(now, [self.key, "generation"], "left_semi")

    def update(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], rebuild: bool = False, before_commit: Callable[[], None] | None = None) -> int:
        """Brings the results to what `rows` now are; returns the generation's number.

        Worked on are keys that are new, changed, or failed before, and with `rebuild` all. work: rows to (key, error, results),
        as attempted() gives them. A repeated key fails; a null key is left out. Keys no longer in `rows` are removed.
        """
        k, old = F.col(self.key), self.entries()
        others = [c for c in rows.columns if c != self.key]
        told = rows.where(k.isNotNull()).select("*", F.sha2(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}), 256).alias("_digest"))
        keys = told.groupBy(self.key).agg(F.max("_digest").alias("digest"), F.count(F.lit(1)).alias("_n"))
        if old is None:
            number = 0
            due, gone = keys, None
        else:
            number = 1 + old.agg(F.max("generation")).first()[0]
            was = old.where(F.col("status") != REMOVED).select(self.key, F.col("digest").alias("_was"), "status")
            stale = F.lit(rebuild) | F.col("_was").isNull() | (F.col("_was") != F.col("digest")) | (F.col("status") == FAILED)
            due = keys.join(was, self.key, "left").where(stale).drop("_was", "status")
            gone = was.join(keys, self.key, "left_anti").select(self.key, F.lit(None).cast("string").alias("digest"), F.lit(REMOVED).alias("status"), F.lit(None).cast("string").alias("error"))
        at = f"{self.path}/{{}}/generation={number}"
        due.write.mode("overwrite").parquet(at.format("due"))
        due = self.spark.read.parquet(at.format("due"))
        single = due.where("_n = 1")
        work(rows.join(single.select(self.key), self.key, "left_semi")).write.mode("overwrite").parquet(at.format("results"))
        made = self.spark.read.parquet(at.format("results")).select(self.key, "error")
        status = F.when(F.col("error").isNull(), DONE).otherwise(FAILED).alias("status")
        new = single.join(made, self.key).select(self.key, "digest", status, "error")
        twice = due.where("_n > 1").select(self.key, "digest", F.lit(FAILED).alias("status"), F.lit(REPEATED).alias("error"))
        if before_commit:
            before_commit()
        every = new.union(twice) if gone is None else new.union(twice).union(gone)
        every.write.mode("overwrite").parquet(at.format("entries"))
        return number
