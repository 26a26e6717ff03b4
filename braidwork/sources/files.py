"""Sources and sinks: media listings, keyed tables, CSV, JSON, JSON lines, notes, transcripts and vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as X

# File name endings that count as media.
MEDIA_ENDINGS = (
    ".mp4", ".m4v", ".mov", ".qt", ".avi", ".wmv", ".asf", ".mkv", ".webm", ".mpg", ".mpeg", ".mpe", ".m2v", ".ts", ".mts", ".m2ts", ".flv", ".f4v", ".3gp", ".3g2", ".ogv", ".rm", ".rmvb", ".vob", ".divx", ".mxf",
)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def is_media(name: Column, endings: tuple[str, ...] = MEDIA_ENDINGS) -> Column:
    return X.extension(name).isin(*endings)


def media_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = MEDIA_ENDINGS) -> DataFrame:
    """(name, path, length) of a folder's media files, by name whatever the case. Contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    named = files.withColumn("name", F.url_decode(F.regexp_extract("path", "([^/]*)$", 1)))
    return named.where(is_media(F.col("name"), endings)).select("name", "path", "length").orderBy(F.lower("name"), "name")


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A CSV file under a declared schema; empty where the file is missing, empty, or lacks a column of the schema."""
    schema = schema_of(ddl)
    if not is_complete(spark, path, ddl):
        return spark.createDataFrame([], schema)
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    return raw.select(*(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields))


def is_complete(spark: SparkSession, path: str, ddl: str) -> bool:
    """Whether a CSV file can be read and has all columns; a header alone will do."""
    try:
        return {f.name for f in schema_of(ddl).fields} <= set(spark.read.csv(path, header=True).columns)
    except AnalysisException:
        return False


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, written also for no rows."""
    (df.coalesce(1) if df.isEmpty() else df).write.mode("overwrite").csv(path, header=True)


def write_keyed(df: DataFrame, path: str, key: str = "video") -> None:
    """Parquet by key: only the keys in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_keyed(spark: SparkSession, path: str, ddl: str, key: str = "video", only: list[str] | None = None) -> DataFrame:
    """All keys' rows, or those of `only`, whose folders alone are read; unreadable files are passed over."""
    schema = schema_of(ddl)
    try:
        df = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    df = df.select(*(f.name for f in schema.fields))
    return df if only is None else df.where(F.col(key).isin(only))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Union of tables by name; columns that a table lacks are null."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys still to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def read_json_array(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(schema_of(ddl)).json(path, multiLine=True)


def write_json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON array of all rows in one text file, for summaries that a reader takes whole; an error beyond `most` rows, for
    which write_jsonl() is meant."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for one JSON array")
    rows = F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns))))
    df.agg(F.concat(F.lit("["), F.array_join(rows, ",\n"), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines, blank ones passed over; an error if there is none."""
    df = spark.read.schema(schema_of(ddl)).json(path)
    if df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(in coverage, out of coverage) questions; comment rows are left out, and no question in coverage is an error."""
    rows = spark.read.schema(schema_of(schemas.GOLDEN)).json(path).where("_comment IS NULL AND id IS NOT NULL").drop("_comment")
    inside = rows.where("type = 'in_coverage'")
    if inside.isEmpty():
        raise ValueError("no in_coverage questions")
    return inside, rows.where("type = 'out_of_coverage'")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the folder's own Markdown files but those that begin with an underscore, by name."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").withColumn("name", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1)))
    return files.where(~F.col("name").startswith("_")).select("name", F.col("value").alias("text")).orderBy("name")


SEGMENT = r"^\*\*\[(\d+:\d{2}(?::\d{2})?)\]\*\*\s*(.*)$"


def parse_transcripts(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: name, title, source_file, duration_s, language; segments: name, n, ts, text)."""
    line = lambda label: F.regexp_extract("text", rf"(?m)^- \*\*{label}:\*\*\s*`?([^`\n]*?)`?\s*$", 1)
    title = F.regexp_extract("text", r"(?m)^#\s+(.+?)\s*$", 1)
    docs = notes.select("name", F.when(title == "", X.stem(F.col("name"))).otherwise(title).alias("title"), line("Source video").alias("source_file"), F.coalesce(X.seconds_of(F.regexp_extract(line("Duration"), r"(\d+(?::\d{2}){1,2})", 1)), F.lit(0)).alias("duration_s"), line("Language").alias("language"))
    rows = notes.select("name", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").rlike(SEGMENT))
    segments = rows.select("name", "n", X.seconds_of(F.regexp_extract("line", SEGMENT, 1)).alias("ts"), F.trim(F.regexp_extract("line", SEGMENT, 2)).alias("text"))
    return docs, segments.where("text <> ''")


def transcript_text(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(name, text): Markdown of transcripts, segments without text left out."""
    said = segments.where(F.trim("text") != "")
    lines = said.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("**["), X.clock_of(F.col("ts")), F.lit("]** "), F.trim("text")).alias("line"))))["line"], "\n\n").alias("body"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n- **Source video:** `"), "source_file", F.lit("`\n- **Duration:** "), X.clock_of(F.col("duration_s")), F.lit("\n- **Language:** "), "language", F.lit("\n\n## Transcript\n\n"))
    return docs.join(lines, "name", "left").select("name", F.concat(head, F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))


def cleaned_text(docs: DataFrame, classified: DataFrame) -> DataFrame:
    """(name, text): Markdown of the sentences kept, under a head with their number."""
    kept = classified.groupBy("name").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("keep")).alias("kept"), F.array_join(F.filter(F.array_sort(F.collect_list(F.struct("n", "keep", F.concat(F.lit("`["), X.clock_of(F.col("ts")), F.lit("]` "), "sentence").alias("line")))), lambda s: s["keep"])["line"], "\n\n").alias("body"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n- **Source video:** `"), "source_file", F.lit("`\n- **Duration:** "), X.clock_of(F.col("duration_s")), F.lit("\n- **Sentences kept:** "), F.col("kept").cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit("\n\n---\n\n"))
    return docs.join(kept, "name").select("name", F.concat(head, "body", F.lit("\n")).alias("text"))


def write_texts(df: DataFrame, path: str) -> None:
    """A text file a task, rows as they are."""
    df.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


class Vectors:
    """A collection of vectors in a Parquet table: replace, add, get, count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def replace(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self, ids: DataFrame, key: str = "id") -> DataFrame:
        return self.table().join(ids.select(key), key, "left_semi")

    def count(self) -> int:
        return self.table().count()


def pose_rows(frames: DataFrame, names: tuple[str, ...] = schemas.KEYPOINT_NAMES) -> DataFrame:
    """One row a keypoint from frames with `people`: array of struct<track_id, box (x1..y2), points: array of struct<x, y, confidence>>.

    A person without a track has their place among the frame's people for one.
    """
    people = frames.select("video", "frame", F.posexplode("people").alias("_i", "p"))
    rows = people.select("video", "frame", F.coalesce(F.col("p.track_id"), F.col("_i")).cast("int").alias("track_id"), *(F.col(f"p.{c}").alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")), F.posexplode("p.points").alias("_k", "k"))
    return rows.select("video", "frame", "track_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", F.get(F.array(*map(F.lit, names)), F.col("_k")).alias("keypoint"), "k.x", "k.y", "k.confidence")


def aligned(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Two streams of rows side by side, each row once, null where one has none."""
    return a.join(b, on, "full_outer")
