"""Queries on ordered series: events as tracks, orders as boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cohort as C
from ..operators import fill as L
from ..operators import motion as M
from ..operators import sequence as S
from .common import events, r6, table

U, E = ["user_id"], "event_id"
WE = "PARTITION BY user_id ORDER BY event_id"


def top1_per_group(spark: SparkSession, d: str) -> DataFrame:
    return S.top1(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


def multi_track_frames(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    return S.shared_groups(ev, ["user_id", "day"], "event_type")


def inner_join_selected(spark: SparkSession, d: str) -> DataFrame:
    best = top1_per_group(spark, d).select("o_custkey", "o_orderkey")
    return table(spark, d, "lineitem").join(best, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), r6(F.sum("l_quantity")).alias("quantity"))


def segment_gap_or_change(spark: SparkSession, d: str) -> DataFrame:
    return S.segments(events(spark, d), U, E, "event_type", 300).select("user_id", "event_id", "segment_id")


def segment_change(spark: SparkSession, d: str) -> DataFrame:
    return S.segments(events(spark, d), U, E, "event_type", None).select("user_id", "event_id", "segment_id")


def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.segment_summary(S.segments(events(spark, d), U, E, "event_type", 300), U, E, "event_type")


def debounce_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.debounce(events(spark, d).drop("ts", "value"), U, E, "event_type").select("user_id", "event_id", "event_type", "stable_id")


def _holed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def moving_avg_centered(spark: SparkSession, d: str) -> DataFrame:
    return S.centred_mean(_holed(spark, d), U, E, ["value"]).select("user_id", "event_id", r6("value_s").alias("value_s"))


def central_difference(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).withColumn("other", F.col("value") * 0.5)
    return S.central_velocity(ev, U, E, "value", "other", 400).select("user_id", "event_id", "vx", r6("speed").alias("speed"))


def gradient_positional(spark: SparkSession, d: str) -> DataFrame:
    return S.gradient(events(spark, d), U, E, ["value"]).select("user_id", "event_id", r6("value_g").alias("value_g"))


def peak_row(spark: SparkSession, d: str) -> DataFrame:
    return S.peak_rows(events(spark, d), U, E, "value", 20).select("user_id", "event_id", "value")


def peak_fallback_mid(spark: SparkSession, d: str) -> DataFrame:
    return S.peak_rows(events(spark, d), U, E, "value", 80, fallback_middle=True).select("user_id", "event_id", "value")


def _dims(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, d, "embeddings").select("vec_id", *(at(i).alias(f"e{i}") for i in range(1, 10)))


def interior_angle(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(f"e{i}") for i in range(1, 10)]
    p = [F.struct(c[i].alias("x"), c[i + 1].alias("y"), c[i + 2].alias("z")) for i in (0, 3, 6)]
    return _dims(spark, d).select("vec_id", r6(G.interior_angle(*c[:6])).alias("angle"), r6(G.interior_angle3(*p)).alias("angle3"), r6(G.tilt_from_vertical(c[0], c[1])).alias("tilt"))


def line_separation(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(f"e{i}") for i in range(1, 10)]
    sep = G.line_separation(G.line_angle(*c[:4]), G.line_angle(*c[4:8]))
    return _dims(spark, d).select("vec_id", r6(sep).alias("separation"), r6(G.inclination(c[0], c[1])).alias("incline"), r6(G.inclination(c[0], c[1], True)).alias("signed_incline"), r6(G.undirected_angle3(tuple(c[:3]), tuple(c[3:6]))).alias("separation3"))


def handedness_case(spark: SparkSession, d: str) -> DataFrame:
    rules = (("1", "lefty"), ("2", "righty"), ("3", "lefty"))
    own = table(spark, d, "customer").select("c_custkey", "c_name")
    side = M.side_of_name(F.col("c_name"), rules)
    return own.select("c_custkey", F.coalesce(side, F.lit("righty")).alias("side"), F.when(side.isNotNull(), "filename").otherwise("default").alias("side_source"))


def travel_side(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    x = lambda t: F.struct(F.when(F.col("event_type") == t, F.col("value")).alias("x"))
    marks = ev.select("user_id", x("click").alias("left_ankle"), x("view").alias("right_ankle"))
    return M.side_of_travel(marks, U)


def band_join_segments(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    bands = S.segment_summary(S.segments(ev, U, E, "event_type", 300), U, E, "event_type").select("user_id", "segment_id", "start_frame", "end_frame")
    hit = L.band_join(ev.select("user_id", "event_id"), bands, U, "event_id", "start_frame", "end_frame", 1000)
    return hit.select("user_id", "segment_id", "event_id")


def semi_anti_membership(spark: SparkSession, d: str) -> DataFrame:
    with_, without = L.split_members(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return with_.withColumn("has_orders", F.lit(True)).unionByName(without.withColumn("has_orders", F.lit(False)))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    src = lambda m, r: ev.where(f"event_id % {m} = {r}").select("user_id", "event_id", "value")
    return L.by_priority(ev.select("user_id", "event_id"), ["user_id", "event_id"], [("detected", src(2, 0)), ("kalman", src(3, 0)), ("wrist_proxy", src(5, 0))], ["value"])


def priority_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)


def coverage_pivot(spark: SparkSession, d: str) -> DataFrame:
    return L.coverage_pivot(_filled(spark, d), U, ["detected", "kalman", "wrist_proxy", "missing"])


def running_median(spark: SparkSession, d: str) -> DataFrame:
    return S.running_median(_holed(spark, d), U, E, "value").select("user_id", "event_id", r6(F.nanvl("running_median", F.lit(None).cast("double"))).alias("running_median"))


def kalman_fill(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d)
    seen = F.col("event_id") % 4 != 0
    frames = ev.select("user_id", "event_id", F.when(seen, F.col("value")).alias("cx"), F.when(seen, F.col("value") * 0.5).alias("cy"), F.lit(80.0).alias("w"), F.lit(80.0).alias("h"))
    made = L.kalman(frames, U, E)
    return made.select("user_id", "event_id", *(r6(c).alias(c) for c in ("k_cx", "k_cy", "k_w", "k_h")))


def overlap_windows_avg(spark: SparkSession, d: str) -> DataFrame:
    windows = S.overlapping(events(spark, d).select("user_id", "event_id", "value"), U, E, 24, 12)
    return S.overlap_mean(windows, U, "value", 24, 12).select("user_id", F.col("idx").cast("long").alias("idx"), r6("value").alias("value"))


def window_starts(spark: SparkSession, d: str) -> DataFrame:
    windows = S.overlapping(events(spark, d).select("user_id", "event_id", "value"), U, E, 24, 12)
    return windows.groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


def pivot_long_to_wide(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    wide = S.pivot_names(ev, ["user_id", "day"], "event_type", ("click", "view", "purchase"), ("value",), "event_id")
    return wide.select("user_id", "day", *(F.col(n)["value"].alias(n) for n in ("click", "view", "purchase")))


def last_third_rate(spark: SparkSession, d: str) -> DataFrame:
    ev = S.last_share(events(spark, d), U, E)
    rate = lambda c: F.avg(c.cast("double"))
    good = F.col("value") > 50
    return ev.groupBy("user_id").agg(r6(rate(good)).alias("rate"), r6(F.avg(F.when(F.col("in_zone"), good.cast("double")))).alias("zone_rate"), (rate(good) < 0.7).alias("alarm"))


def histogram_20(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 1.0, 51.0, 20)


def trail_10(spark: SparkSession, d: str) -> DataFrame:
    t = S.trail(events(spark, d), U, E, ["value"], 10)
    return t.select("user_id", "event_id", F.size("trail").alias("n"), r6(F.aggregate("trail", F.lit(0.0), lambda a, x: a + x["value"])).alias("total"))


def frame_stack(spark: SparkSession, d: str) -> DataFrame:
    s = S.stacked(events(spark, d), U, E, "event_id")
    return s.select("user_id", "event_id", *(F.element_at("stack", i + 1).alias(f"s{i}") for i in range(3)))


def look_back_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.look_back(events(spark, d), U, E, ["value"], 3).select("user_id", "event_id", "value_back")


def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.sampled_positions(events(spark, d), U, E).select("user_id", "event_id")


def min_length(spark: SparkSession, d: str) -> DataFrame:
    return M.long_enough(events(spark, d), U, 60).select("user_id", "event_id")


def value_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _holed(spark, d).groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), r6(F.avg(F.col("value").isNotNull().cast("int")) * 100).alias("coverage_pct"))


def bands(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return events(spark, d).groupBy(M.confidence_band(v / 100).alias("band"), M.in_band(v).alias("in_band")).agg(F.count(F.lit(1)).alias("n"))


def neighbour_set(spark: SparkSession, d: str) -> DataFrame:
    return C.around(events(spark, d).where("event_type = 'purchase'"), U, E)


def cohort_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = C.percentiles(table(spark, d, "lineitem").withColumn("v", F.col("l_extendedprice").cast("double")), ["l_returnflag"], "v")
    return p.select("l_returnflag", *(r6(c).alias(c) for c in ("p10", "p25", "p50", "p75", "p90")), "n")


def swing_rates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") + 40).cast("double").alias("bat"), (F.col("l_extendedprice") % 120).cast("double").alias("exit"), F.lit(90.0).alias("pitch"), (F.col("l_linenumber") * 8 - 10).cast("double").alias("angle"))
    out = C.rates(li, ["l_returnflag"], "bat", "exit", "pitch", "angle")
    return out.select("l_returnflag", *(r6(c).alias(c) for c in out.columns[1:]))


def hardest_half(spark: SparkSession, d: str) -> DataFrame:
    return C.mean_of_top(events(spark, d), U, "value", 0.5, "ev50").select("user_id", r6("ev50").alias("ev50"))


def ball_types(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(C.ball_type(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    top1_per_group, multi_track_frames, inner_join_selected, segment_gap_or_change, segment_change, segment_summary, debounce_labels, moving_avg_centered, central_difference, gradient_positional,
    peak_row, peak_fallback_mid, interior_angle, line_separation, handedness_case, travel_side, band_join_segments, semi_anti_membership, priority_fill, coverage_pivot, running_median, kalman_fill,
    overlap_windows_avg, window_starts, pivot_long_to_wide, last_third_rate, histogram_20, trail_10, frame_stack, look_back_rows, sampled_rows, min_length, value_ranges, bands, neighbour_set,
    cohort_percentiles, swing_rates, hardest_half, ball_types,
)}

_SEG = f"SELECT user_id, event_id, event_type, sum(new) OVER ({WE} ROWS UNBOUNDED PRECEDING) AS segment_id FROM (SELECT *, CASE WHEN event_type <> lag(event_type) OVER ({WE}) OR event_id - lag(event_id) OVER ({WE}) > 300 THEN 1 ELSE 0 END AS new FROM events)"
_SUM = f"SELECT user_id, CAST(segment_id AS INTEGER) AS segment_id, min_by(event_type, event_id) AS event_type, min(event_id) AS start_frame, max(event_id) AS end_frame, count(*) AS frame_count FROM ({_SEG}) GROUP BY user_id, segment_id"
_FILL = """SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0 THEN value END AS value,
  CASE WHEN event_id % 2 = 0 THEN 'detected' WHEN event_id % 3 = 0 THEN 'kalman' WHEN event_id % 5 = 0 THEN 'wrist_proxy' ELSE 'missing' END AS source FROM events"""
_HOLED = "(SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
_DIMS = "(SELECT vec_id, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(1, 10)) + " FROM embeddings)"
_ANG3 = "degrees(acos(greatest(-1.0, least(1.0, ({dot}) / ((sqrt({na}) + 1e-9) * (sqrt({nb}) + 1e-9))))))"


def _angle3(a: list[str], b: list[str]) -> str:
    return _ANG3.format(dot=" + ".join(f"({x})*({y})" for x, y in zip(a, b, strict=True)), na=" + ".join(f"({x})*({x})" for x in a), nb=" + ".join(f"({x})*({x})" for x in b))


_POS = f"(SELECT *, row_number() OVER ({WE}) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_WIN = f"""(SELECT p.user_id, w.window AS win, o.off, p.n, CASE WHEN p.n <= 24 THEN greatest(0, least(p.n - 1, o.off - (24 - p.n) // 2)) ELSE least(p.n - 1, w.window * 12 + o.off) END AS idx
  FROM (SELECT DISTINCT user_id, n FROM {_POS}) p, LATERAL (SELECT unnest(range(0, CASE WHEN p.n <= 24 THEN 1 ELSE (p.n - 1) // 12 + 1 END)) AS window) w, LATERAL (SELECT unnest(range(0, 24)) AS off) o)"""
_NEXT = "PARTITION BY user_id ORDER BY i"
_DEBOUNCED = f"""WITH RECURSIVE p AS (SELECT user_id, event_id, event_type, row_number() OVER ({WE}) AS i, lead(event_type) OVER ({WE}) AS n1 FROM events),
  one(user_id, i, v) AS (SELECT user_id, i, event_type FROM p WHERE i = 1 UNION ALL
    SELECT p.user_id, p.i, CASE WHEN p.event_type <> one.v AND p.n1 = one.v THEN one.v ELSE p.event_type END FROM one JOIN p ON p.user_id = one.user_id AND p.i = one.i + 1),
  q AS (SELECT user_id, i, v, lead(v) OVER ({_NEXT}) AS n1, lead(v, 2) OVER ({_NEXT}) AS n2 FROM one),
  two(user_id, i, v, held) AS (SELECT user_id, i, v, false FROM q WHERE i = 1 UNION ALL
    SELECT user_id, i, CASE WHEN held OR blip THEN was ELSE v END, blip AND NOT held
    FROM (SELECT q.user_id, q.i, q.v, two.v AS was, two.held, coalesce(q.v <> two.v AND q.n1 = q.v AND q.n2 = two.v, false) AS blip FROM two JOIN q ON q.user_id = two.user_id AND q.i = two.i + 1))
  SELECT user_id, event_id, event_type, two.v AS stable_id FROM p JOIN two USING (user_id, i)"""


def _filtered() -> str:
    """The filter of each axis by itself: place x, step v, and their variances a, c and covariance b."""
    first = ", ".join(f"z * {f} AS x{k}, CAST(0 AS DOUBLE) AS v{k}, CAST({L.START_VARIANCE[k]} AS DOUBLE) AS a{k}, CAST(0 AS DOUBLE) AS b{k}, CAST({L.START_VARIANCE[k + 2]} AS DOUBLE) AS c{k}" for k, f in ((0, "1.0"), (1, "0.5")))
    moved = ", ".join(f"x{k} + v{k} AS x{k}, v{k}, a{k} + 2 * b{k} + c{k} + {L.PROCESS_VARIANCE[k]} AS a{k}, b{k} + c{k} AS b{k}, c{k} + {L.PROCESS_VARIANCE[k + 2]} AS c{k}" for k in (0, 1))
    put = lambda k, f: (s := f"(a{k} + {L.MEASURE_VARIANCE[k]})", gap := f"(z * {f} - x{k})") and {
        "x": f"x{k} + a{k} / {s} * {gap}", "v": f"v{k} + b{k} / {s} * {gap}", "a": f"a{k} - a{k} / {s} * a{k}", "b": f"b{k} - a{k} / {s} * b{k}", "c": f"c{k} - b{k} / {s} * b{k}"}
    told = ", ".join(f"CASE WHEN z IS NULL THEN {n}{k} ELSE {e} END AS {n}{k}" for k, f in ((0, "1.0"), (1, "0.5")) for n, e in put(k, f).items())
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(value AS DOUBLE) END AS z FROM events),
  p AS (SELECT user_id, event_id, z, row_number() OVER ({WE}) AS i FROM (SELECT *, min(CASE WHEN z IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id) AS began FROM e) WHERE event_id >= began),
  k AS (SELECT user_id, event_id, i, z, {first} FROM p WHERE i = 1 UNION ALL
    SELECT user_id, event_id, i, z, {told} FROM (SELECT p.user_id, p.event_id, p.i, p.z, {moved} FROM k JOIN p ON p.user_id = k.user_id AND p.i = k.i + 1))
  SELECT user_id, event_id, round(x0, 6) AS k_cx, round(x1, 6) AS k_cy, CAST(80 AS DOUBLE) AS k_w, CAST(80 AS DOUBLE) AS k_h FROM k WHERE z IS NULL"""


ORACLE = {
    "debounce_labels": _DEBOUNCED,
    "kalman_fill": _filtered(),
    "top1_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "multi_track_frames": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT event_type) AS n_ids FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1",
    "inner_join_selected": "SELECT o_custkey, o_orderkey, count(*) AS n_lines, round(CAST(sum(l_quantity) AS DOUBLE), 6) AS quantity FROM lineitem JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) ON l_orderkey = o_orderkey WHERE rn = 1 GROUP BY 1, 2",
    "segment_gap_or_change": f"SELECT user_id, event_id, CAST(segment_id AS INTEGER) AS segment_id FROM ({_SEG})",
    "segment_change": f"SELECT user_id, event_id, CAST(sum(new) OVER ({WE} ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_id FROM (SELECT *, CASE WHEN event_type <> lag(event_type) OVER ({WE}) THEN 1 ELSE 0 END AS new FROM events)",
    "segment_summary": _SUM,
    "moving_avg_centered": f"SELECT user_id, event_id, round(avg(value) OVER ({WE} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS value_s FROM {_HOLED}",
    "central_difference": f"""SELECT user_id, event_id, CASE WHEN ok THEN (nv - pv) / (ne - pe) END AS vx, round(CASE WHEN ok THEN sqrt(pow((nv - pv) / (ne - pe), 2) + pow(0.5 * (nv - pv) / (ne - pe), 2)) END, 6) AS speed
      FROM (SELECT *, event_id - pe <= 400 AND ne - event_id <= 400 AND ne > pe AS ok FROM (SELECT user_id, event_id, coalesce(lag(event_id) OVER ({WE}), event_id) AS pe, coalesce(lead(event_id) OVER ({WE}), event_id) AS ne, coalesce(lag(value) OVER ({WE}), value) AS pv, coalesce(lead(value) OVER ({WE}), value) AS nv FROM events))""",
    "gradient_positional": f"SELECT user_id, event_id, round(CASE WHEN n < 2 THEN NULL WHEN b IS NULL THEN a - value WHEN a IS NULL THEN value - b ELSE (a - b) / 2 END, 6) AS value_g FROM (SELECT *, lag(value) OVER ({WE}) AS b, lead(value) OVER ({WE}) AS a, count(*) OVER (PARTITION BY user_id) AS n FROM events)",
    "peak_row": "SELECT user_id, event_id, value FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE n >= 20 AND rn = 1",
    "peak_fallback_mid": f"SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM {_POS}) WHERE CASE WHEN n >= 80 THEN rn = 1 ELSE idx = n // 2 END",
    "interior_angle": f"""SELECT vec_id, round(degrees(acos(greatest(-1.0, least(1.0, ((e1-e3)*(e5-e3) + (e2-e4)*(e6-e4)) / (sqrt(pow(e1-e3,2)+pow(e2-e4,2)) * sqrt(pow(e5-e3,2)+pow(e6-e4,2))))))), 6) AS angle,
      round({_angle3(["e1-e4", "e2-e5", "e3-e6"], ["e7-e4", "e8-e5", "e9-e6"])}, 6) AS angle3, round(degrees(acos(greatest(-1.0, least(1.0, -e2 / sqrt(e1*e1+e2*e2))))), 6) AS tilt FROM {_DIMS}""",
    "line_separation": f"""SELECT vec_id, round(least(d, 180 - d), 6) AS separation, round(degrees(atan2(-e2, abs(e1))), 6) AS incline, round(degrees(atan2(-e2, e1)), 6) AS signed_incline, round(least(t, 180 - t), 6) AS separation3
      FROM (SELECT *, abs(degrees(atan2(e4-e2, e3-e1)) - degrees(atan2(e8-e6, e7-e5))) % 180 AS d, {_angle3(["e1", "e2", "e3"], ["e4", "e5", "e6"])} AS t FROM {_DIMS})""",
    "handedness_case": "SELECT c_custkey, CASE WHEN contains(c_name, '1') THEN 'lefty' WHEN contains(c_name, '2') THEN 'righty' WHEN contains(c_name, '3') THEN 'lefty' ELSE 'righty' END AS side, CASE WHEN contains(c_name, '1') OR contains(c_name, '2') OR contains(c_name, '3') THEN 'filename' ELSE 'default' END AS side_source FROM customer",
    "travel_side": """SELECT user_id, CASE WHEN ln >= 5 AND rn >= 5 AND greatest(l, r) >= 8 THEN CASE WHEN l > r * 1.15 THEN 'righty' WHEN r > l * 1.15 THEN 'lefty' END END AS side
      FROM (SELECT user_id, count(CASE WHEN event_type = 'click' THEN value END) AS ln, count(CASE WHEN event_type = 'view' THEN value END) AS rn, max(CASE WHEN event_type = 'click' THEN value END) - min(CASE WHEN event_type = 'click' THEN value END) AS l, max(CASE WHEN event_type = 'view' THEN value END) - min(CASE WHEN event_type = 'view' THEN value END) AS r FROM events GROUP BY user_id)""",
    "band_join_segments": f"SELECT e.user_id, s.segment_id, e.event_id FROM events e JOIN ({_SUM}) s ON e.user_id = s.user_id AND e.event_id BETWEEN s.start_frame AND s.end_frame",
    "semi_anti_membership": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer",
    "priority_fill": _FILL,
    "coverage_pivot": f"SELECT user_id, count(*) FILTER (source = 'detected') AS detected, count(*) FILTER (source = 'kalman') AS kalman, count(*) FILTER (source = 'wrist_proxy') AS wrist_proxy, count(*) FILTER (source = 'missing') AS missing, count(*) AS total, round((count(*) - count(*) FILTER (source = 'missing')) / count(*) * 100, 1) AS coverage_pct FROM ({_FILL}) GROUP BY user_id",
    "running_median": f"SELECT user_id, event_id, round(median(value) OVER ({WE} ROWS UNBOUNDED PRECEDING), 6) AS running_median FROM {_HOLED}",
    "overlap_windows_avg": f"SELECT user_id, idx, round(value, 6) AS value FROM {_POS}",
    "window_starts": f"SELECT w.user_id, CAST(w.win AS INTEGER) AS \"window\", count(*) AS n, round(sum(p.value), 6) AS total FROM {_WIN} w JOIN {_POS} p ON w.user_id = p.user_id AND w.idx = p.idx GROUP BY 1, 2",
    "pivot_long_to_wide": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, " + ", ".join(f"coalesce(arg_max(value, event_id) FILTER (event_type = '{t}'), 0.0) AS {t}" for t in ("click", "view", "purchase")) + " FROM events GROUP BY 1, 2",
    "last_third_rate": f"SELECT user_id, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN idx >= floor(n * (2.0::DOUBLE / 3)) THEN CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END END), 6) AS zone_rate, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) < 0.7 AS alarm FROM {_POS} GROUP BY user_id",
    "histogram_20": "SELECT l_returnflag, CAST(least(floor((l_quantity - 1.0) / 2.5) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 51 GROUP BY 1, 2",
    "trail_10": f"SELECT user_id, event_id, CAST(count(*) OVER w AS INTEGER) AS n, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS ({WE} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "frame_stack": f"SELECT user_id, event_id, coalesce(lag(event_id) OVER ({WE}), event_id) AS s0, event_id AS s1, coalesce(lead(event_id) OVER ({WE}), event_id) AS s2 FROM events",
    "look_back_rows": f"SELECT user_id, event_id, coalesce(lag(value, 3) OVER ({WE}), first_value(value) OVER ({WE})) AS value_back FROM events",
    "sampled_rows": f"SELECT user_id, event_id FROM {_POS} WHERE idx IN (CAST(floor(n * (1::DOUBLE / 6)) AS BIGINT), CAST(floor(n * 0.5::DOUBLE) AS BIGINT), CAST(floor(n * (5::DOUBLE / 6)) AS BIGINT))",
    "min_length": f"SELECT user_id, event_id FROM {_POS} WHERE n >= 60",
    "value_ranges": f"SELECT user_id, min(value) AS lo, max(value) AS hi, round(count(value) * 100.0::DOUBLE / count(*), 6) AS coverage_pct FROM {_HOLED} GROUP BY user_id",
    "bands": "SELECT CASE WHEN value / 100 >= 0.7 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' ELSE 'low' END AS band, value BETWEEN 5 AND 20 AS in_band, count(*) AS n FROM events GROUP BY 1, 2",
    "neighbour_set": "SELECT DISTINCT user_id, event_id + d AS event_id FROM events, (SELECT unnest([-1, 0, 1]) AS d) WHERE event_type = 'purchase' AND event_id + d >= 0",
    "cohort_percentiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + ", count(l_extendedprice) AS n FROM lineitem GROUP BY 1",
    "swing_rates": """SELECT l_returnflag, round(avg(CASE WHEN bat >= 75 THEN 1.0 ELSE 0.0 END), 6) AS fast_swing_rate, round(avg(CASE WHEN x / (bat + 18.0) >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS squared_up_rate,
      round(avg(CASE WHEN bat >= 75 AND x / (bat + 18.0) >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS blast_rate, round(avg(CASE WHEN x >= 95 THEN 1.0 ELSE 0.0 END), 6) AS hard_hit_rate, round(avg(CASE WHEN a BETWEEN 8 AND 32 THEN 1.0 ELSE 0.0 END), 6) AS sweet_spot_rate, round(avg(greatest(x, 88.0)), 6) AS adjusted_exit
      FROM (SELECT l_returnflag, CAST(l_quantity + 40 AS DOUBLE) AS bat, CAST(l_extendedprice % 120 AS DOUBLE) AS x, CAST(l_linenumber * 8 - 10 AS DOUBLE) AS a FROM lineitem) GROUP BY 1""",
    "hardest_half": "SELECT user_id, round(avg(value), 6) AS ev50 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= greatest(1, n // 2) GROUP BY 1",
    "ball_types": "SELECT CASE WHEN value < 10 THEN 'ground_ball' WHEN value < 25 THEN 'line_drive' WHEN value < 50 THEN 'fly_ball' ELSE 'popup' END AS kind, count(*) AS n FROM events GROUP BY 1",
}
