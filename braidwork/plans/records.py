"""Queries on boxes, keypoints, notes, transcripts, splits, unions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import answer as A
from ..operators import cohort as C
from ..operators import evaluate as V
from ..operators import fill as L
from ..operators import motion as M
from ..operators import sequence as S
from ..sources import files as X
from .common import events, r6, shared, table

#: Detections to a frame.
TRACKS = 97
#: A frame's width: a prime, so that no quotient lies half-way between two rounded values, where engines differ.
WIDTH = 1913
#: What the query's generator says: too little to the first question with TRIGGER in it, enough to others and when asked again.
SHORT_ANSWER, FULL_ANSWER, TRIGGER = "no", "Keep the hands inside the ball and turn.", "haha"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    left = F.coalesce("value", F.lit(0.0)) + e / 1000
    box = {"bat_x1": left, "bat_y1": (e % 5).cast("double"), "bat_x2": left + 10 + e % 7, "bat_y2": (e % 5 + 3 * (e % 6)).cast("double"), "bat_conf": F.when(e % 10 > 0, e % 10 / 10.0)}
    return events(spark, d).select(F.col("user_id").cast("string").alias("video"), F.floor(e / TRACKS).cast("int").alias("frame"), *(c.alias(n) for n, c in box.items()))


def best_boxes(spark: SparkSession, d: str) -> DataFrame:
    return L.best_box(_boxes(spark, d)).select("video", "frame", r6("bat_x1").alias("bat_x1"), "bat_conf")


def box_labels(spark: SparkSession, d: str) -> DataFrame:
    ends = L.end_labels(_boxes(spark, d))
    sweet = {f"sweet_{a}": G.lerp(F.col(f"knob_{a}"), F.col(f"tip_{a}"), 0.7) for a in "xy"}
    rows = ends.withColumns(sweet)
    sx, sy = G.screen_normalised(F.col("sweet_x"), F.col("sweet_y"), F.lit(float(WIDTH)), F.lit(1080.0))
    return rows.select("video", "frame", *(r6(c).alias(c) for c in ("knob_x", "knob_y", "tip_x", "tip_y", "sweet_x", "sweet_y")), r6(sx).alias("screen_x"), r6(sy).alias("screen_y"))


def _pair(spark: SparkSession, d: str, name: str) -> DataFrame:
    e, value = F.col("event_id"), F.coalesce("value", F.lit(0.0))
    side = lambda s, i: F.struct(F.lit(f"{s}_{name}").alias("keypoint"), (value + 13 * i + e % (i + 2)).alias("x"), (29.0 * i + e % (i + 5)).alias("y"), ((e * (i + 3)) % 10 / 10.0).alias("confidence"))
    return events(spark, d).select("user_id", e.alias("frame"), F.inline(F.array(side("left", 0), side("right", 1))))


def shoulder_lengths(spark: SparkSession, d: str) -> DataFrame:
    return L.shoulder_lengths(_pair(spark, d, "shoulder"), ["user_id"]).select("user_id", r6("length").alias("length"))


def hand_points(spark: SparkSession, d: str) -> DataFrame:
    return M.hands(_pair(spark, d, "wrist"), ["user_id", "frame"]).select("user_id", "frame", r6("x").alias("x"), r6("y").alias("y"))


def pose_frames(spark: SparkSession, d: str) -> DataFrame:
    e, value = F.col("event_id"), F.col("value")
    point = lambda i: F.struct((value + i).alias("x"), (e % 7 + i + 0.5).alias("y"), (e % 10 / 10.0).alias("confidence"))

    def person(track, i: int):
        box = (F.lit(float(i)).alias("x1"), F.lit(0.0).alias("y1"), (value + i).alias("x2"), F.lit(9.0).alias("y2"))
        return F.struct(track.cast("int").alias("track_id"), *box, F.array(point(i), point(i + 1)).alias("points"))

    return events(spark, d).select(F.col("user_id").cast("string").alias("video"), e.cast("int").alias("frame"), F.array(person(F.lit(40), 0), person(F.lit(None), 1)).alias("people"))


def pose_points(spark: SparkSession, d: str) -> DataFrame:
    return X.pose_rows(pose_frames(spark, d)).select("video", "frame", "track_id", "keypoint", r6("bbox_x2").alias("bbox_x2"), r6("x").alias("x"), r6("y").alias("y"), "confidence")


def heat_peaks(spark: SparkSession, d: str) -> DataFrame:
    heat = G.blob(6, 9, F.col("p_partkey") % 9, F.col("p_partkey") % 6, 1.5)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the keys are few bytes, but long work: a file is one task
    return table(spark, d, "part").select("p_partkey").repartition(parts, "p_partkey").select("p_partkey", G.peak(heat, 9).alias("top")).select("p_partkey", F.col("top.x").cast("long").alias("x"), F.col("top.y").cast("long").alias("y"), r6("top.value").alias("value"))


def value_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage(events(spark, d), ["event_type"], "value").select("event_type", r6("coverage_pct").alias("coverage_pct"))


def first_values(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id", "event_type").agg(S.first_by("value", "event_id").alias("first"))


def row_positions(spark: SparkSession, d: str) -> DataFrame:
    return S.position(events(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "idx")


def value_maps(spark: SparkSession, d: str) -> DataFrame:
    told = S.map_of(events(spark, d), ["user_id"], "event_id", ("event_type",), "by_id")
    return told.select("user_id", F.explode("by_id").alias("event_id", "v")).select("user_id", "event_id", "v.event_type")


def listing_slice(spark: SparkSession, d: str) -> DataFrame:
    return S.batches(events(spark, d).select("event_id", "event_type"), "event_id", 50, 120)


def keyed_split(spark: SparkSession, d: str) -> DataFrame:
    train, held = C.split_by_key(table(spark, d, "documents").select("doc_id"), "doc_id", 0.15)
    return train.withColumn("part", F.lit("training")).unionByName(held.withColumn("part", F.lit("validation")))


def heading_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    columns = {
        "heading": T.heading_cleaned(F.concat(F.col("doc_id").cast("string"), F.lit(". "), text)),
        "named": T.without_media_id(F.concat(F.lit("Talk [dQw4w9WgXcQ] "), text)),
        "ruled": T.without_rules(F.concat(text, F.lit("\n---\nend\n * * *\n***"))),
        "id": T.numbered_id(T.stem(F.concat(F.lit("notes/"), "source", F.lit(".v2.md"))), F.col("doc_id")),
        "preview": T.preview(text, 80),
        "n_tokens": T.token_count(text),
    }
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in columns.items()))


def _talks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, d, "conversations")
    name = F.col("conv_id").cast("string")
    docs = turns.select("conv_id").distinct().select(name.alias("name"), F.concat(F.lit("Talk "), name).alias("title"), F.concat(name, F.lit(".mp4")).alias("source_file"), (F.col("conv_id") * 61).cast("int").alias("duration_s"), F.lit("en").alias("language"))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return docs, turns.select(name.alias("name"), F.col("turn").cast("int").alias("n"), (F.col("turn") * 437).cast("int").alias("ts"), flat.alias("text"))


def transcript_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs, segments = X.parse_transcripts(X.transcript_text(*_talks(spark, d)))
    return docs.join(segments.select("name", "ts", "text"), "name")


def cleaned_notes(spark: SparkSession, d: str) -> DataFrame:
    docs, segments = _talks(spark, d)
    classified = segments.select("name", "n", "ts", F.col("text").alias("sentence"), (F.length("text") % 3 > 0).alias("keep"))
    return X.cleaned_text(docs, classified)


def golden_questions(spark: SparkSession, d: str) -> DataFrame:
    at, inside = shared(spark), F.length("text") % 3 > 0
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), F.when(inside, "in_coverage").otherwise("out_of_coverage").alias("type"), F.col("text").alias("q"), F.array(F.lit("a"), F.lit("b")).alias("expect_sources"), F.when(F.length("text") % 11 == 0, "aside").alias("_comment"))
    X.write_jsonl(asked, at)
    found = X.read_golden(spark, at)
    return found[0].unionByName(found[1]).select("id", "type", "q", F.array_join("expect_sources", ",").alias("expected"))


def vector_collection(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    store, late = X.Vectors(spark, shared(spark)), F.coalesce(F.col("label") >= 3, F.lit(False))
    store.replace(own.where(~late))
    store.add(own.where(late))
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return store.get(wanted).select("id", "label", F.lit(store.count()).alias("all"))


def merged_tables(spark: SparkSession, d: str) -> DataFrame:
    both = X.merged([table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "toxic")])
    return both.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"))


def pending_keys(spark: SparkSession, d: str) -> DataFrame:
    return X.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


def aligned_streams(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("key"), "c_name")
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), "s_name")
    return X.aligned(customers, suppliers, ["key"])


def source_matching(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.source_matches(F.col("text"), F.array("lang", F.lit("HAHA"), "source")).alias("matches"))


def behaviour_rate(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "labels").select((F.col("toxic") == 1).alias("answered"), (F.col("quality") == 1).alias("expected"))
    return V.behaviour(told).select(r6("accuracy").alias("accuracy"), "n")


def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    hits = table(spark, d, "conversations").select("conv_id", turn.cast("int").alias("rank"), F.col("role").alias("source_title"), T.clock_of((turn * 437).cast("int")).alias("timestamp"), "text", turn.cast("string").alias("id"))
    return A.context(hits, "conv_id").select("conv_id", "context", F.array_join(F.transform("sources", lambda s: F.concat_ws("@", s["chunk_id"], s["title"])), ",").alias("sources"))


def _generate(prompts: list[str]) -> list[str]:
    return [SHORT_ANSWER if TRIGGER in p and "was rejected" not in p else FULL_ANSWER for p in prompts]


def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), (F.length("text") % 10 / 10.0).alias("score"), F.lit("notes").alias("context"), F.lit(None).cast("string").alias("history"))
    policy = A.Policy(report="no such report", off_topic="no such topic", threshold=0.3)
    return A.answered(asked, _generate, policy).select("item_id", r6("score").alias("score"), "answer", "abstained", "attempts", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        best_boxes, box_labels, shoulder_lengths, hand_points, pose_points, heat_peaks, value_coverage, first_values, row_positions, value_maps, listing_slice, keyed_split, heading_texts, transcript_round_trip,
        cleaned_notes, golden_questions, vector_collection, merged_tables, pending_keys, aligned_streams, source_matching, behaviour_rate, answer_contexts, answered_questions,
    )
}

_LEFT = "coalesce(value, 0) + event_id / 1000.0::DOUBLE"
_BOXES = f"""(SELECT CAST(user_id AS VARCHAR) AS video, CAST(event_id // {TRACKS} AS INTEGER) AS frame, {_LEFT} AS x1, CAST(event_id % 5 AS DOUBLE) AS y1, {_LEFT} + 10 + event_id % 7 AS x2, CAST(event_id % 5 + 3 * (event_id % 6) AS DOUBLE) AS y2, CASE WHEN event_id % 10 > 0 THEN event_id % 10 / 10.0::DOUBLE END AS conf FROM events)"""
_PAIR = "(SELECT user_id, event_id AS frame, coalesce(value, 0) + event_id % 2 AS lx, event_id % 5 AS ly, event_id * 3 % 10 / 10.0 AS lc, coalesce(value, 0) + 13 + event_id % 3 AS rx, 29.0::DOUBLE + event_id % 6 AS ry, event_id * 4 % 10 / 10.0 AS rc FROM events)"
_CLOCK = "CASE WHEN {0} >= 3600 THEN printf('%d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60) ELSE printf('%d:%02d', {0} // 60, {0} % 60) END"
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"

ORACLE = {
    "best_boxes": f"SELECT video, frame, round(x1, 6) AS bat_x1, conf AS bat_conf FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY conf DESC NULLS LAST, x1, y1) AS rn FROM {_BOXES}) WHERE rn = 1",
    "box_labels": f"""WITH e AS (SELECT video, frame, x1 AS kx, CASE WHEN x2 - x1 >= y2 - y1 THEN y2 ELSE y1 END AS ky, x2 AS tx, CASE WHEN x2 - x1 >= y2 - y1 THEN y1 ELSE y2 END AS ty FROM {_BOXES} WHERE conf IS NULL OR conf >= 0.5),
      s AS (SELECT *, kx + 0.7::DOUBLE * (tx - kx) AS sx, ky + 0.7::DOUBLE * (ty - ky) AS sy FROM e)
      SELECT video, frame, round(kx, 6) AS knob_x, round(ky, 6) AS knob_y, round(tx, 6) AS tip_x, round(ty, 6) AS tip_y, round(sx, 6) AS sweet_x, round(sy, 6) AS sweet_y, round(sx / {WIDTH} * 2 - 1, 6) AS screen_x, round(sy / {WIDTH} * 2 - 1080.0::DOUBLE / {WIDTH}, 6) AS screen_y FROM s""",
    "shoulder_lengths": f"SELECT user_id, round(median(sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry))) * (86.0::DOUBLE / 47.5::DOUBLE), 6) AS length FROM {_PAIR} GROUP BY 1",
    "hand_points": f"""SELECT user_id, frame, round(list_avg(list_filter([CASE WHEN lc >= 0.3 THEN lx END, CASE WHEN rc >= 0.3 THEN rx END], lambda v: v IS NOT NULL)), 6) AS x, round(list_avg(list_filter([CASE WHEN lc >= 0.3 THEN ly END, CASE WHEN rc >= 0.3 THEN ry END], lambda v: v IS NOT NULL)), 6) AS y FROM {_PAIR}""",
    "pose_points": """SELECT CAST(user_id AS VARCHAR) AS video, CAST(event_id AS INTEGER) AS frame, CASE WHEN i = 0 THEN 40 ELSE 1 END AS track_id, CASE WHEN k = 0 THEN 'nose' ELSE 'left_eye' END AS keypoint, round(value + i, 6) AS bbox_x2, round(value + i + k, 6) AS x, CAST(event_id % 7 + i + k + 0.5 AS DOUBLE) AS y, event_id % 10 / 10.0::DOUBLE AS confidence
      FROM events, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS k)""",
    "heat_peaks": "SELECT p_partkey, CAST(p_partkey % 9 AS BIGINT) AS x, CAST(p_partkey % 6 AS BIGINT) AS y, 1.0::DOUBLE AS value FROM part",
    "value_coverage": "SELECT event_type, round(100.0::DOUBLE * count(value) / count(*), 6) AS coverage_pct FROM events GROUP BY 1",
    "first_values": "SELECT user_id, event_type, min_by(value, event_id) FILTER (value IS NOT NULL) AS first FROM events GROUP BY 1, 2",
    "row_positions": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS idx FROM events",
    "value_maps": "SELECT user_id, event_id, event_type FROM events",
    "listing_slice": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 70 OFFSET 50",
    "keyed_split": "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('0:' || doc_id), 1, 8) AS BIGINT) % 10000 < 1500 THEN 'validation' ELSE 'training' END AS part FROM documents",
    "heading_texts": r"""SELECT doc_id, trim(text) AS heading, trim('Talk ' || text) AS named, array_to_string(list_filter(string_split(text || chr(10) || '---' || chr(10) || 'end' || chr(10) || ' * * *' || chr(10) || '***', chr(10)), lambda x: NOT regexp_matches(trim(x), '^(?:-{3,}|\*{3,}|_{3,})$')), chr(10)) AS ruled,
      printf('%s::%03d', source || '.v2', doc_id) AS id, CASE WHEN length(f) > 80 THEN regexp_replace(substr(f, 1, 80), '\s+\S*$', '') || '...' ELSE f END AS preview, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n_tokens FROM (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS f FROM documents)""",
    "transcript_round_trip": f"SELECT CAST(conv_id AS VARCHAR) AS name, 'Talk ' || conv_id AS title, conv_id || '.mp4' AS source_file, CAST(conv_id * 61 AS INTEGER) AS duration_s, 'en' AS language, CAST(turn * 437 AS INTEGER) AS ts, {_FLAT} AS text FROM conversations WHERE {_FLAT} <> ''",
    "cleaned_notes": f"""WITH t AS (SELECT conv_id, turn, turn * 437 AS ts, {_FLAT} AS s FROM conversations)
      SELECT CAST(conv_id AS VARCHAR) AS name, '# Talk ' || conv_id || chr(10) || chr(10) || '- **Source video:** `' || conv_id || '.mp4`' || chr(10) || '- **Duration:** ' || {_CLOCK.format("(conv_id * 61)")} || chr(10) || '- **Sentences kept:** ' || count(*) FILTER (length(s) % 3 > 0) || ' of ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
        || coalesce(string_agg('`[' || {_CLOCK.format("ts")} || ']` ' || s, chr(10) || chr(10) ORDER BY turn) FILTER (length(s) % 3 > 0), '') || chr(10) AS text FROM t GROUP BY conv_id""",
    "golden_questions": "SELECT 'q' || item_id AS id, CASE WHEN length(text) % 3 > 0 THEN 'in_coverage' ELSE 'out_of_coverage' END AS type, text AS q, 'a,b' AS expected FROM benchmark WHERE length(text) % 11 <> 0",
    "vector_collection": 'SELECT vec_id AS id, label, (SELECT count(*) FROM embeddings) AS "all" FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)',
    "merged_tables": "SELECT lang, toxic, count(*) AS n FROM (SELECT lang, NULL AS toxic FROM documents UNION ALL SELECT NULL, toxic FROM labels) GROUP BY 1, 2",
    "pending_keys": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "aligned_streams": "SELECT CAST(coalesce(c_custkey, s_suppkey) AS BIGINT) AS key, c_name, s_name FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey",
    "source_matching": "SELECT doc_id, contains(lower(text), lower(lang)) OR contains(lower(text), 'haha') OR contains(lower(text), lower(source)) AS matches FROM documents",
    "behaviour_rate": "SELECT round(avg(CASE WHEN (toxic = 1) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labels",
    "answer_contexts": f"""SELECT conv_id, string_agg('[' || role || ' | ' || {_CLOCK.format("(turn * 437)")} || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context, string_agg(turn || '@' || role, ',' ORDER BY turn) AS sources FROM conversations GROUP BY 1""",
    "answered_questions": f"""SELECT item_id, score, CASE WHEN score < 0.3 THEN 'I don''t have material covering that.' ELSE '{FULL_ANSWER}' END AS answer, score < 0.3 AS abstained, CASE WHEN score < 0.3 THEN 0 WHEN contains(text, '{TRIGGER}') THEN 2 ELSE 1 END AS attempts, CASE WHEN score < 0.3 THEN 'below_threshold' END AS reason
      FROM (SELECT item_id, text, length(text) % 10 / 10.0::DOUBLE AS score FROM benchmark)""",
}
