"""Queries on the chain from keypoints to metrics: events stand for detections, a user for a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cohort as C
from ..operators import fill as L
from ..operators import motion as M
from .common import events, r6
from .series import ORACLE as SERIES
from .series import WE, _angle3

NAMES = ("left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")
JOINTS = ("LHip", "RHip", "LShoulder", "RShoulder", "LElbow", "RElbow", "LWrist", "RWrist")
#: Detections to a frame.
TRACKS = 97
JOINT_METRICS = ("hip_shoulder_sep", "lead_elbow_ext", "attack_angle_3d", "speed", "shoulder_tilt")
FPS = 120.0
ARMS = ("left_wrist", "right_wrist", "left_elbow", "right_elbow")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    box = {"bbox_x1": F.col("value"), "bbox_y1": F.lit(0.0), "bbox_x2": F.col("value") + 10 + e % 7, "bbox_y2": 5.0 + e % 5}
    return events(spark, d).where("value IS NOT NULL").select(F.col("user_id").cast("string").alias("video"), F.floor(e / TRACKS).cast("int").alias("frame"), (e % TRACKS).cast("int").alias("track_id"), *(c.alias(n) for n, c in box.items()))


def track_select(spark: SparkSession, d: str) -> DataFrame:
    return M.select_tracks(_detections(spark, d), mode="change").select("video", "frame", "track_id", "segment_id")


def _keypoints(spark: SparkSession, d: str) -> DataFrame:
    e, value = F.col("event_id"), F.coalesce("value", F.lit(0.0))

    def point(i: int, name: str) -> Column:
        return F.struct(F.lit(name).alias("keypoint"), (value + 13 * i + e % (i + 2)).alias("x"), (29.0 * i * i + e % (i + 5)).alias("y"), ((e * (i + 3)) % 10 / 10.0).alias("confidence"))

    return events(spark, d).select("user_id", "event_id", F.inline(F.array(*(point(i, n) for i, n in enumerate(NAMES)))))


def frame_metrics(spark: SparkSession, d: str) -> DataFrame:
    marks = M.landmarks(_keypoints(spark, d), ["user_id", "event_id"]).withColumn("handedness", F.when(F.col("user_id") % 2 == 0, "righty").otherwise("lefty"))
    told = M.frame_metrics(marks)
    return told.select("user_id", "event_id", *(r6(c).alias(c) for c in ("hip_shoulder_sep", "spine_tilt", "front_knee_angle")))


def handedness_cascade(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).withColumn("video", F.concat(F.when(F.col("user_id") % 3 == 0, "Lefty_").otherwise("clip_"), F.col("user_id").cast("string")))
    x = lambda t: F.struct(F.when(F.col("event_type") == t, F.col("value")).alias("x"))
    return M.sides(ev.select("video", x("click").alias("left_ankle"), x("view").alias("right_ankle")))


def percentile_of(spark: SparkSession, d: str) -> DataFrame:
    told = C.percentile_of(events(spark, d).select("event_id", "event_type", "value"), ["event_type"], "value")
    return told.select("event_id", r6("percentile").alias("percentile"))


def path_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    points = events(spark, d).select("user_id", "event_id", F.when(e % 7 != 0, F.col("value")).alias("x"), (F.col("value") * 0.5 + e % 11).alias("y"))
    told = M.path_metrics(points, ["user_id"], "event_id", max_step=400)
    return told.select("user_id", "event_id", *(r6(c).alias(c) for c in ("x_s", "y_s", "speed", "attack_angle")))


def _joints(spark: SparkSession, d: str) -> DataFrame:
    e, value = F.col("event_id"), F.coalesce("value", F.lit(0.0))
    at = lambda i: F.struct((value + 13 * i + e % (i + 2)).alias("x"), (29.0 * i * i + e % (i + 5)).alias("y"), (3.0 * (e % (i + 3)) + i).alias("z"))
    joints = F.create_map(*(c for i, n in enumerate(JOINTS) for c in (F.lit(n), at(i))))
    poses = events(spark, d).select("user_id", "event_id", joints.alias("joints"), F.when(F.col("user_id") % 2 == 0, "righty").otherwise("lefty").alias("handedness"))
    return M.joint_metrics(poses, ["user_id"], order="event_id")


def joint_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _joints(spark, d).select("user_id", "event_id", *(r6(c).alias(c) for c in JOINT_METRICS))


def joint_summary(spark: SparkSession, d: str) -> DataFrame:
    told = M.joint_summary(_joints(spark, d), ["user_id"], "event_id")
    return told.select("user_id", "contact_frame", "n_frames", *(r6(c).alias(c) for c in told.columns if c.startswith(JOINT_METRICS)))


def wrist_proxy(spark: SparkSession, d: str) -> DataFrame:
    e, value = F.col("event_id"), F.coalesce("value", F.lit(0.0))
    at = lambda i: F.when((e * (i + 3)) % 10 >= 2, F.struct((value * (i + 1) / 4).alias("x"), (29.0 * i + e % (i + 5)).alias("y")))
    marks = events(spark, d).select("user_id", "event_id", *(at(i).alias(n) for i, n in enumerate(ARMS)), F.lit(80.0).alias("length"), F.when(F.col("user_id") % 2 == 0, "righty").otherwise("lefty").alias("handedness"))
    told = L.wrist_proxy(marks)
    return told.select("user_id", "event_id", *(r6(f"p_{c}").alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2", "cx", "cy", "knob_x", "knob_y", "tip_x", "tip_y")))


def implement_path(spark: SparkSession, d: str) -> DataFrame:
    """A tracked implement's contact by user: its knob, tip and sweet spot, of which every ninth row has none."""
    e, value = F.col("event_id"), F.coalesce("value", F.lit(0.0))
    place = {"knob_x": value, "knob_y": (e % 7).cast("double"), "tip_x": value + 30 + e % 13, "tip_y": 40.5 - e % 17}
    seen = events(spark, d).select(F.col("user_id").alias("video"), e.alias("frame"), *(F.when(e % 9 != 0, c).alias(n) for n, c in place.items()))
    track = seen.withColumns({f"sweet_{a}": G.lerp(F.col(f"knob_{a}"), F.col(f"tip_{a}"), 0.7) for a in "xy"})
    told = M.bat_path(track, FPS)
    return told.select(F.col("video").alias("user_id"), "contact_frame", "in_ideal_band", *(r6(c).alias(c) for c in ("attack_angle_deg", "swing_path_tilt_deg", "attack_direction", "coverage_pct")))


QUERIES = {f.__name__: f for f in (track_select, frame_metrics, handedness_cascade, percentile_of, path_metrics, joint_metrics, joint_summary, wrist_proxy, implement_path)}


def _metrics_sql() -> str:
    points = ", ".join(f"CASE WHEN (event_id * {i + 3}) % 10 >= 3 THEN coalesce(value, 0) + {13 * i} + event_id % {i + 2} END AS x{i}, CASE WHEN (event_id * {i + 3}) % 10 >= 3 THEN {29 * i * i}.0::DOUBLE + event_id % {i + 5} END AS y{i}" for i in range(len(NAMES)))
    middle = lambda k, a, b: f"coalesce(({k}{a} + {k}{b}) / 2, {k}{a}, {k}{b})"
    apart = "abs(degrees(atan2(y1 - y0, x1 - x0)) - degrees(atan2(y3 - y2, x3 - x2))) % 180"
    dx, dy = (f"({middle(k, 0, 1)} - {middle(k, 2, 3)})" for k in "xy")

    def knee(a: int, b: int, c: int) -> str:
        long = f"(sqrt((x{a}-x{b})*(x{a}-x{b}) + (y{a}-y{b})*(y{a}-y{b})) * sqrt((x{c}-x{b})*(x{c}-x{b}) + (y{c}-y{b})*(y{c}-y{b})))"
        return f"CASE WHEN {long} > 0 THEN degrees(acos(greatest(-1, least(1, ((x{a}-x{b})*(x{c}-x{b}) + (y{a}-y{b})*(y{c}-y{b})) / {long})))) END"

    length = f"sqrt({dx} * {dx} + {dy} * {dy})"
    return f"""WITH p AS (SELECT user_id, event_id, {points} FROM events), s AS (SELECT *, {apart} AS d FROM p)
SELECT user_id, event_id, round(least(d, 180 - d), 6) AS hip_shoulder_sep,
  round(CASE WHEN {length} > 0 THEN degrees(acos(greatest(-1, least(1, -{dy} / {length})))) END, 6) AS spine_tilt,
  round(CASE WHEN user_id % 2 = 0 THEN {knee(2, 4, 6)} ELSE {knee(3, 5, 7)} END, 6) AS front_knee_angle FROM s"""

_PATH = f"""WITH s AS (SELECT user_id, event_id, avg(CASE WHEN event_id % 7 <> 0 THEN value END) OVER w AS xs, avg(CASE WHEN event_id % 7 <> 0 AND value IS NOT NULL THEN value * 0.5 + event_id % 11 END) OVER w AS ys FROM events WINDOW w AS ({WE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  n AS (SELECT *, lag(event_id) OVER v AS pe, lead(event_id) OVER v AS ne, lag(xs) OVER v AS px, lead(xs) OVER v AS nx, lag(ys) OVER v AS py, lead(ys) OVER v AS ny FROM s WINDOW v AS ({WE})),
  m AS (SELECT *, coalesce(ne, event_id) - coalesce(pe, event_id) AS dt, CASE WHEN ne IS NULL THEN xs ELSE nx END - CASE WHEN pe IS NULL THEN xs ELSE px END AS dx, CASE WHEN ne IS NULL THEN ys ELSE ny END - CASE WHEN pe IS NULL THEN ys ELSE py END AS dy FROM n),
  g AS (SELECT *, CASE WHEN dt > 0 AND coalesce(event_id - pe, 0) <= 400 AND coalesce(ne - event_id, 0) <= 400 THEN dt END AS ok FROM m)
  SELECT user_id, event_id, round(xs, 6) AS x_s, round(ys, 6) AS y_s, round(sqrt(pow(dx / ok, 2) + pow(dy / ok, 2)), 6) AS speed, round(degrees(atan2(-(dy / ok), abs(dx / ok))), 6) + 0 AS attack_angle FROM g"""


def _joints_sql() -> str:
    at = ", ".join(f"coalesce(value, 0) + {13 * i} + event_id % {i + 2} AS x{i}, {29 * i * i}.0::DOUBLE + event_id % {i + 5} AS y{i}, 3.0::DOUBLE * (event_id % {i + 3}) + {i} AS z{i}" for i in range(len(JOINTS)))
    to = lambda a, b: [f"{k}{b} - {k}{a}" for k in "xyz"]
    rise = lambda x, y, z: f"degrees(atan2(-({y}), sqrt(pow({x}, 2) + pow({z}, 2))))"
    moved = ", ".join(f"CASE WHEN n < 2 THEN NULL WHEN pe IS NULL THEN lead({k}) OVER w - {k} WHEN ne IS NULL THEN {k} - lag({k}) OVER w ELSE (lead({k}) OVER w - lag({k}) OVER w) / 2 END AS v{k}" for k in "xyz")
    turn = _angle3(to(0, 1), to(2, 3))
    return f"""p AS (SELECT user_id, event_id, {at} FROM events),
  h AS (SELECT *, {", ".join(f"({k}6 + {k}7) / 2 AS {k}" for k in "xyz")}, lag(event_id) OVER w AS pe, lead(event_id) OVER w AS ne, count(*) OVER (PARTITION BY user_id) AS n FROM p WINDOW w AS ({WE})),
  g AS (SELECT *, {moved} FROM h WINDOW w AS ({WE})),
  j AS (SELECT user_id, event_id, n, row_number() OVER ({WE}) - 1 AS i, least({turn}, 180 - {turn}) AS hip_shoulder_sep, CASE WHEN user_id % 2 = 0 THEN {_angle3(to(4, 2), to(4, 6))} ELSE {_angle3(to(5, 3), to(5, 7))} END AS lead_elbow_ext,
    {rise("vx", "vy", "vz")} AS attack_angle_3d, sqrt(vx * vx + vy * vy + vz * vz) AS speed, {rise(*to(2, 3))} AS shoulder_tilt FROM g)"""


def _proxy_sql() -> str:
    at = ", ".join(f"CASE WHEN (event_id * {i + 3}) % 10 >= 2 THEN coalesce(value, 0) * {i + 1} / 4 END AS x{i}, CASE WHEN (event_id * {i + 3}) % 10 >= 2 THEN {29 * i}.0::DOUBLE + event_id % {i + 5} END AS y{i}" for i in range(4))
    pick = lambda k, a, b: f"CASE WHEN user_id % 2 = 0 THEN {k}{a} ELSE {k}{b} END"
    return f"""WITH p AS (SELECT user_id, event_id, {at} FROM events),
  q AS (SELECT user_id, event_id, {", ".join(f"{pick(k, 0, 1)} AS k{k}, {pick(k, 1, 0)} AS t{k}, {pick(k, 1, 0)} - {pick(k, 3, 2)} AS e{k}" for k in "xy")} FROM p),
  r AS (SELECT *, {", ".join(f"CASE WHEN sqrt(ex * ex + ey * ey) > {L.LEAST_NORM} THEN 0.5::DOUBLE * (t{k} - k{k}) + 0.5::DOUBLE * e{k} ELSE t{k} - k{k} END AS d{k}" for k in "xy")} FROM q),
  s AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) >= {L.LEAST_NORM} THEN sqrt(dx * dx + dy * dy) END AS n FROM r),
  t AS (SELECT user_id, event_id, {", ".join(f"CASE WHEN n IS NOT NULL THEN k{k} END AS u{k}, k{k} + d{k} / n * 80 AS w{k}" for k in "xy")} FROM s)
  SELECT user_id, event_id, {", ".join(f"round(CASE WHEN w{k} IS NOT NULL THEN least(u{k}, w{k}) END - {L.MARGIN}, 6) AS p_{k}1, round(CASE WHEN w{k} IS NOT NULL THEN greatest(u{k}, w{k}) END + {L.MARGIN}, 6) AS p_{k}2, round((u{k} + w{k}) / 2, 6) AS p_c{k}, round(u{k}, 6) AS p_knob_{k}, round(w{k}, 6) AS p_tip_{k}" for k in "xy")} FROM t"""


_CONTACT = ("hip_shoulder_sep", "lead_elbow_ext", "attack_angle_3d", "shoulder_tilt")

ORACLE = {
    "path_metrics": _PATH,
    "joint_metrics": f"WITH {_joints_sql()} SELECT user_id, event_id, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in JOINT_METRICS)} FROM j",
    "joint_summary": f"""WITH {_joints_sql()}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY speed DESC NULLS LAST, event_id) AS place, max(hip_shoulder_sep) OVER u AS turn_max, max(lead_elbow_ext) OVER u AS elbow_max FROM j WINDOW u AS (PARTITION BY user_id))
  SELECT user_id, event_id AS contact_frame, n AS n_frames, round(turn_max, 6) AS hip_shoulder_sep_max, round(elbow_max, 6) AS lead_elbow_ext_max, {", ".join(f"round({c}, 6) + 0 AS {c}_at_contact" for c in _CONTACT)}
  FROM b WHERE CASE WHEN n >= 20 THEN place = 1 AND speed IS NOT NULL ELSE i = n // 2 END""",
    "wrist_proxy": _proxy_sql(),
    "implement_path": f"""WITH t AS (SELECT user_id, event_id AS frame, CASE WHEN event_id % 9 <> 0 THEN coalesce(value, 0) END AS kx, CASE WHEN event_id % 9 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END AS ky, CASE WHEN event_id % 9 <> 0 THEN coalesce(value, 0) + 30 + event_id % 13 END AS tx, CASE WHEN event_id % 9 <> 0 THEN 40.5::DOUBLE - event_id % 17 END AS ty FROM events),
p AS (SELECT *, kx + 0.7::DOUBLE * (tx - kx) AS x, ky + 0.7::DOUBLE * (ty - ky) AS y FROM t),
s AS (SELECT *, avg(x) OVER c AS sx, avg(y) OVER c AS sy FROM p WINDOW c AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
g AS (SELECT *, CASE WHEN count(*) OVER u < 2 THEN NULL WHEN lag(frame) OVER w IS NULL THEN lead(sx) OVER w - sx WHEN lead(frame) OVER w IS NULL THEN sx - lag(sx) OVER w ELSE (lead(sx) OVER w - lag(sx) OVER w) / 2 END AS gx,
  CASE WHEN count(*) OVER u < 2 THEN NULL WHEN lag(frame) OVER w IS NULL THEN lead(sy) OVER w - sy WHEN lead(frame) OVER w IS NULL THEN sy - lag(sy) OVER w ELSE (lead(sy) OVER w - lag(sy) OVER w) / 2 END AS gy,
  CASE WHEN row_number() OVER w > 5 THEN lag(sx, 5) OVER w ELSE first_value(sx) OVER w END AS bx, CASE WHEN row_number() OVER w > 5 THEN lag(sy, 5) OVER w ELSE first_value(sy) OVER w END AS by_,
  100.0::DOUBLE * count(x) OVER u / count(*) OVER u AS cover FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame), u AS (PARTITION BY user_id)),
b AS (SELECT *, degrees(atan2(-gy, gx)) AS angle, row_number() OVER (PARTITION BY user_id ORDER BY sqrt(gx * gx + gy * gy) DESC NULLS LAST, frame) AS place FROM g)
SELECT user_id, frame AS contact_frame, coalesce(angle BETWEEN {M.ANGLE_BAND[0]} AND {M.ANGLE_BAND[1]}, false) AS in_ideal_band, round(angle, 6) + 0 AS attack_angle_deg, round(degrees(atan2(ty - ky, tx - kx)), 6) + 0 AS swing_path_tilt_deg, round(degrees(atan2(-(sy - by_), sx - bx)), 6) + 0 AS attack_direction, round(cover, 6) AS coverage_pct FROM b WHERE place = 1 AND gx IS NOT NULL""",
    "track_select": f"""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS video, CAST(event_id // {TRACKS} AS INTEGER) AS frame, CAST(event_id % {TRACKS} AS INTEGER) AS track_id, (10 + event_id % 7) * (5 + event_id % 5) AS area, value FROM events WHERE value IS NOT NULL),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY (value + 10 + (frame * {TRACKS} + track_id) % 7 - value) * (5.0::DOUBLE + (frame * {TRACKS} + track_id) % 5) DESC, track_id) = 1),
c AS (SELECT *, CASE WHEN track_id <> lag(track_id) OVER (PARTITION BY video ORDER BY frame) THEN 1 ELSE 0 END AS new FROM t)
SELECT video, frame, track_id, CAST(sum(new) OVER (PARTITION BY video ORDER BY frame) AS INTEGER) AS segment_id FROM c""",
    "frame_metrics": _metrics_sql(),
    "handedness_cascade": f"""SELECT CASE WHEN user_id % 3 = 0 THEN 'Lefty_' ELSE 'clip_' END || user_id AS video,
  CASE WHEN user_id % 3 = 0 THEN 'lefty' ELSE coalesce(side, 'righty') END AS handedness,
  CASE WHEN user_id % 3 = 0 THEN 'filename' WHEN side IS NOT NULL THEN 'pose' ELSE 'default' END AS handedness_source FROM ({SERIES["travel_side"]})""",
    "percentile_of": "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value NULLS FIRST), 6) AS percentile FROM events",
}
