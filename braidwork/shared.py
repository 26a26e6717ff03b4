"""Tables that a job writes on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table up to which it is sent to every executor.
SENT = 500_000


def shared(spark: SparkSession) -> str:
    """A new folder's path where driver and executors both see it: under spark.checkpoint.dir; where that is unset, a temporary
    one in local mode, and an error on a cluster."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(found or tempfile.mkdtemp()).rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: what is above it is not worked out again, whatever is lost."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most: int = SENT) -> DataFrame:
    """A small written table, marked to be sent whole to every executor if it has `most` rows or fewer; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
