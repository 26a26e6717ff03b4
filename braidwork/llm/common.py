"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def column(df: DataFrame, name: str) -> Column:
    """A top-level column by its name, dots and all."""
    return df[quoted(name)]


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def packed(df: DataFrame, name: str) -> Column:
    """All columns as one struct, whose fields no other name can clash with."""
    return F.struct(*(column(df, c) for c in df.columns)).alias(name)


def unpacked(df: DataFrame, name: str) -> DataFrame:
    """The columns that packed() put away, and no others."""
    return df.select(*(F.col(name).getField(f.name).alias(f.name) for f in df.schema[name].dataType.fields))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode
    (tests), where there is one machine; on a cluster, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and no executor's loss reaches it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text; an empty array where there are none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))
