import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork import schemas
from braidwork.functions import geometry as G
from braidwork.operators import cohort, fill, motion
from braidwork.operators import sequence as S

BOX = "video string, frame int, track_id int"


@pytest.mark.parametrize("ids, want", [("AABAA", "AAAAA"), ("ABABA", "AAAAA"), ("ABBA", "AAAA"), ("AABBB", "AABBB"), ("ABBBA", "ABBBA"), ("", ""), ("A", "A"), ("AB", "AB")])
def test_debounced(ids, want):
    assert "".join(S.debounced(list(ids))) == want


def test_segments_by_gap_and_change(spark):
    rows = [("a", 0, 1), ("a", 15, 1), ("b", 0, 1), ("b", 16, 1), ("c", 0, 1), ("c", 1, 1), ("c", 2, 2), ("c", 3, 2), ("c", 4, 2)]
    df = spark.createDataFrame(rows, BOX)
    got = {(r.video, r.frame): r.segment_id for r in S.segments(df, ["video"], "frame", "track_id", 15).collect()}
    assert [got["a", 0], got["a", 15], got["b", 0], got["b", 16]] == [0, 0, 0, 1]
    assert [got["c", i] for i in range(5)] == [0, 0, 1, 1, 1]
    s = {(r.video, r.segment_id): (r.start_frame, r.end_frame, r.frame_count) for r in S.segment_summary(S.segments(df, ["video"], "frame", "track_id"), ["video"], "frame", "track_id").collect()}
    assert s["c", 1] == (2, 4, 3)


def test_select_tracks(spark):
    def box(frame, track, size):
        return [("v", frame, track, 0.0, 0.0, float(size), float(size), k, 1.0, 1.0, 0.9) for k in ("nose", "left_eye")]

    rows = box(0, 1, 10) + box(0, 2, 20) + box(1, 3, 5) + box(1, 2, 5) + box(2, 2, 9) + box(30, 2, 9)
    got = motion.select_tracks(spark.createDataFrame(rows, schemas.KEYPOINTS)).groupBy("frame", "track_id", "segment_id").count().orderBy("frame").collect()
    assert [tuple(r) for r in got] == [(0, 2, 0, 2), (1, 2, 0, 2), (2, 2, 0, 2), (30, 2, 1, 2)]


def test_geometry_by_hand(spark):
    c = lambda v: F.lit(float(v))
    one = spark.range(1)
    values = one.select(
        G.line_separation(G.line_angle(c(0), c(0), c(10), c(0)), G.line_angle(c(0), c(10), c(10), c(20))).alias("sep"),
        G.tilt_from_vertical(c(0), c(-10)).alias("tilt"),
        G.interior_angle(c(0), c(0), c(0), c(10), c(10), c(10)).alias("knee"),
        G.interior_angle(c(0), c(0), c(0), c(0), c(1), c(1)).alias("none"),
        G.inclination(c(-1), c(-1)).alias("folded"),
        G.inclination(c(-1), c(-1), True).alias("signed"),
        G.vector_angle3((c(1), c(0), c(0)), (c(0), c(2), c(0))).alias("a3"),
        G.undirected_angle3((c(1), c(0), c(0)), (c(-1), c(0.001), c(0))).alias("u3"),
        G.lerp(c(0), c(10), 0.7).alias("lerp"),
        G.cosine(F.array(c(0.6), c(0.8)), F.array(c(1), c(0))).alias("cos"),
    ).first()
    assert values.none is None
    assert [values.sep, values.tilt, values.knee, values.folded, values.signed, values.a3, values.lerp, values.cos] == pytest.approx([45, 0, 90, 45, 135, 90, 7, 0.6], abs=1e-6)
    assert values.u3 < 0.1


def test_heat_map_peak(spark):
    row = spark.range(1).select(G.peak(G.blob(5, 7, F.lit(4.0), F.lit(2.0), 1.0), 7).alias("p"), G.peak(F.array(*[F.lit(0.1)] * 4), 2).alias("low")).first()
    assert (row.p.x, row.p.y, row.p.value) == (4, 2, 1.0) and row.low is None


def test_box_ends(spark):
    row = spark.range(1).select(*(e.alias(n) for n, e in zip(("k", "t"), G.box_ends(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(2.0)), strict=True))).first()
    assert (row.k.x, row.k.y, row.t.x, row.t.y) == (0, 2, 10, 0)
    row = spark.range(1).select(*(e.alias(n) for n, e in zip(("k", "t"), G.box_ends(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(10.0)), strict=True))).first()
    assert (row.k.x, row.k.y, row.t.x, row.t.y) == (0, 0, 2, 10)


def path(spark, points):
    return spark.createDataFrame([("v", f, x, y) for f, x, y in points], "video string, frame int, x double, y double")


@pytest.mark.parametrize("sign, signed, want", [(1, False, 45), (-1, False, 45), (-1, True, 135), (1, True, 45)])
def test_path_angles(spark, sign, signed, want):
    got = motion.path_metrics(path(spark, [(t, float(sign * t), float(-t)) for t in range(20)]), ["video"], signed=signed)
    assert {round(r.attack_angle, 6) for r in got.collect()} == {want}
    assert S.peak_rows(got, ["video"], "frame", "speed", 20).count() == 1


def test_short_path_has_no_contact(spark):
    got = motion.path_metrics(path(spark, [(t, float(t), 0.0) for t in range(19)]), ["video"])
    assert S.peak_rows(got, ["video"], "frame", "speed", 20).count() == 0
    assert S.peak_rows(got, ["video"], "frame", "speed", 20, fallback_middle=True).first().frame == 9


def test_holes_have_no_velocity(spark):
    got = {r.frame: r.speed for r in S.central_velocity(path(spark, [(0, 0.0, 0.0), (1, 1.0, 0.0), (5, 5.0, 0.0), (6, 6.0, 0.0)]), ["video"], "frame", "x", "y").collect()}
    assert got == {0: 1.0, 1: None, 5: None, 6: 1.0}
    assert S.central_velocity(path(spark, [(3, 0.0, 0.0)]), ["video"], "frame", "x", "y").first().speed is None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=12))
def test_gradient_equals_numpy(spark, values):
    got = S.gradient(path(spark, [(i * 3, v, 0.0) for i, v in enumerate(values)]), ["video"], "frame", ["x"]).orderBy("frame").collect()
    assert [r.x_g for r in got] == pytest.approx(np.gradient(values).tolist())


def test_centred_mean_fills_rows_in_valid_windows(spark):
    points = [(0, None, None), (1, None, None), (2, None, None), (3, 3.0, 6.0), (4, None, None), (9, 5.0, 10.0)]
    got = [r.y_s for r in S.centred_mean(path(spark, points), ["video"], "frame", ["x", "y"]).orderBy("frame").collect()]
    assert got == [None, 6.0, 6.0, 8.0, 8.0, 8.0]


@pytest.mark.parametrize("n, windows", [(1, 1), (4, 1), (5, 3), (9, 5)])
def test_windows_give_back_what_went_in(spark, n, windows):
    df = path(spark, [(i * 2, float(i * i), 0.0) for i in range(n)])
    w = S.overlapping(df, ["video"], "frame", 4, 2)
    assert w.groupBy("window").count().where("count = 4").count() == windows == w.select("window").distinct().count()
    assert {r.idx: r.x for r in S.overlap_mean(w, ["video"], "x", 4, 2).collect()} == {i: float(i * i) for i in range(n)}


def keypoints(spark, points, confidence=0.9):
    return spark.createDataFrame([("righty clip", 0, 1, 0.0, 0.0, 1.0, 1.0, k, float(x), float(y), float(c)) for k, x, y, c in points], schemas.KEYPOINTS)


def test_landmarks_and_frame_metrics(spark):
    points = [("left_shoulder", 0, 0, 1), ("right_shoulder", 10, 0, 1), ("left_hip", 0, 10, 0.29), ("right_hip", 10, 20, 1)]
    marks = motion.landmarks(keypoints(spark, points), ["video", "frame"])
    row = motion.frame_metrics(marks.withColumn("handedness", F.lit("righty"))).first()
    assert row.hip_shoulder_sep is None and (row.center_hip.x, row.center_hip.y) == (10, 20) and (row.neck.x, row.neck.y) == (5, 0)
    assert row.front_knee_angle is None
    full = motion.landmarks(keypoints(spark, [*points[:2], ("left_hip", 0, 10, 1), ("right_hip", 10, 20, 1)]), ["video", "frame"])
    assert motion.frame_metrics(full.withColumn("handedness", F.lit("righty"))).first().hip_shoulder_sep == pytest.approx(45)


def test_hands_and_sides(spark):
    h = motion.hands(keypoints(spark, [("left_wrist", 0, 0, 1), ("right_wrist", 4, 2, 0.5), ("nose", 9, 9, 1)]), ["video", "frame"]).first()
    assert (h.x, h.y) == (2, 1)
    names = spark.createDataFrame([("Lefty righty",), ("x RIGHTY",), ("Ichiro",), ("z",)], "n string")
    assert [r[0] for r in names.select(motion.side_of_name(F.col("n"))).collect()] == ["lefty", "righty", "lefty", None]
    rows = [("v", 0, 1, 0.0, 0.0, 1.0, 1.0, k, float(x * s), 0.0, 1.0) for x in range(6) for k, s in (("left_ankle", 10), ("right_ankle", 1))]
    rows = [(v, i // 2, *rest) for i, (v, _, *rest) in enumerate(rows)]
    marks = motion.landmarks(spark.createDataFrame(rows, schemas.KEYPOINTS), ["video", "frame"])
    assert [tuple(r) for r in motion.sides(marks).collect()] == [("v", "righty", "pose")]


def test_segment_metrics(spark):
    moved = motion.path_metrics(path(spark, [(t, float(t * t), float(-t)) for t in range(20)]), ["video"])
    metrics = path(spark, [(t, 0.0, 0.0) for t in range(20)]).select("video", "frame", F.lit(30.0).alias("hip_shoulder_sep"), F.col("frame").cast("double").alias("spine_tilt"), F.lit(None).cast("double").alias("front_knee_angle"))
    row = motion.segment_metrics(moved, metrics, ["video"]).first()
    assert row.n_frames == 20 and row.spine_tilt_range == [0.0, 19.0] and row.at_contact.spine_tilt == row.contact_frame and len(row.per_frame) == 20


def test_joint_metrics_in_space(spark):
    def joints(t):
        p = {"LHip": (0, 0, 0), "RHip": (1, 0, 0), "LShoulder": (0, -1, 0), "RShoulder": (1, -1, 1), "LElbow": (0, 0, 0), "LWrist": (1, 0, 0), "RWrist": (1, -t * t, 0), "RElbow": (0, 0, 0)}
        return {k: tuple(map(float, v)) for k, v in p.items()}

    poses = spark.createDataFrame([("v", 0, t, joints(t)) for t in range(20)], schemas.JOINTS_3D).withColumn("handedness", F.lit("righty"))
    row = motion.joint_summary(motion.joint_metrics(poses, ["video", "segment_id"]), ["video", "segment_id"]).first()
    assert row.contact_frame == 19 and row.hip_shoulder_sep_max == pytest.approx(45, abs=1e-4) and row.lead_elbow_ext_max == pytest.approx(90, abs=1e-4)
    assert row.attack_angle_3d_at_contact == pytest.approx(90)


def test_band_join_with_and_without_buckets(spark):
    rows = spark.createDataFrame([("v", i) for i in range(100)], "video string, frame int")
    bands = spark.createDataFrame([("v", 1, 5, 40), ("v", 2, 38, 61), ("w", 3, 0, 99), ("v", 4, 9, 8)], "video string, s int, lo int, hi int")
    want = {(f, s) for s, lo, hi in ((1, 5, 40), (2, 38, 61)) for f in range(lo, hi + 1)}
    for width in (None, 7):
        got = fill.band_join(rows, bands, ["video"], "frame", "lo", "hi", width).collect()
        assert len(got) == len(want) and {(r.frame, r.s) for r in got} == want


def test_filter_stands_still_without_velocity(spark):
    rows = [("v", 0, None), ("v", 1, 50.0), ("v", 2, None), ("v", 3, None)]
    frames = spark.createDataFrame([(v, f, x, x, 8.0, 6.0) for v, f, x in rows], "video string, frame int, cx double, cy double, w double, h double")
    got = {r.frame: (r.k_cx, r.k_cy, r.k_w, r.k_h) for r in fill.kalman(frames, ["video"]).collect()}
    assert got == {2: (50.0, 50.0, 8.0, 6.0), 3: (50.0, 50.0, 8.0, 6.0)}
    assert fill.kalman(frames, ["video"], max_gap=1).count() == 1


def test_filter_follows_a_line():
    kf = fill.Filter(0, 0)
    for t in range(1, 30):
        kf.predict()
        kf.update(3.0 * t, -t)
    assert kf.predict() == pytest.approx((90, -30), abs=0.5)


def test_wrist_proxy(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    marks = spark.range(1).select(p(0, 0).alias("left_wrist"), p(10, 0).alias("right_wrist"), p(9, 0).alias("right_elbow"), p(0, 0).alias("left_elbow"), F.lit("right").alias("handedness"), F.lit(100.0).alias("length"))
    row = fill.wrist_proxy(marks).first()
    assert (row.p_knob_x, row.p_tip_x, row.p_cx, row.p_x1, row.p_x2, row.p_y1) == (0, 100, 50, -12, 112, -12)
    near = marks.withColumn("right_wrist", p(2, 0))
    assert fill.wrist_proxy(near).first().p_cx is None


def test_every_frame_has_one_source(spark):
    spine = spark.createDataFrame([("v", i) for i in range(10)], "video string, frame int")
    of = lambda ids: spark.createDataFrame([("v", i, float(i)) for i in ids], "video string, frame int, cx double")
    filled = fill.by_priority(spine, ["video", "frame"], [("detected", of([0, 1])), ("kalman", of([1, 2, 3])), ("wrist_proxy", of([9]))], ["cx"])
    assert filled.count() == 10
    row = fill.coverage_pivot(filled, ["video"], ["detected", "kalman", "wrist_proxy", "missing"]).first()
    assert (row.detected, row.kalman, row.wrist_proxy, row.missing, row.total, row.coverage_pct) == (2, 2, 1, 5, 10, 50.0)


def test_samples_and_splits(spark):
    df = spark.range(1000).withColumn("kind", F.col("id") % 2)
    a, b = (sorted(r.id for r in cohort.stratified_sample(d, F.col("kind"), "id", 5).collect()) for d in (df, df.repartition(3)))
    assert a == b and len(a) == 10
    train, held = cohort.split_by_key(df, "id", 0.15)
    assert train.count() + held.count() == 1000 and 100 < held.count() < 200 and train.join(held, "id").count() == 0
    assert math.isclose(cohort.percentiles(df, ["kind"], "id").where("kind = 0").first().p50, 499)


def test_debounce_by_windows_equals_the_fold(spark):
    rng = np.random.default_rng(3)
    groups = {g: [[None, "a", "b", "c"][x] for x in rng.integers(0, 4 if g % 2 else 3, rng.integers(0, 40))] for g in range(120)}
    rows = [(g, i, x) for g, ids in groups.items() for i, x in enumerate(ids)]
    got = S.debounce(spark.createDataFrame(rows, "g int, i int, who string"), ["g"], "i", "who").collect()
    by = {(r.g, r.i): r.stable_id for r in got}
    assert len(got) == len(rows)
    for g, ids in groups.items():
        assert [by[g, i] for i in range(len(ids))] == S.debounced(ids), ids


def test_order_statistics_of_hot_values_and_nulls(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", 5.0)] * 400 + [("hot", float(x)) for x in rng.integers(0, 9, 300)] + [("small", 1.5), ("nulls", None), (None, 2.0), (None, None), ("hot", None)]
    df = spark.createDataFrame(rows, "c string, v double")
    p = {r.c: r for r in cohort.percentiles(df, ["c"], "v").collect()}
    own = np.array([v for c, v in rows if c == "hot" and v is not None])
    assert [p["hot"][f"p{q}"] for q in (10, 25, 50, 75, 90)] == pytest.approx(list(np.percentile(own, [10, 25, 50, 75, 90])))
    assert (p["hot"].n, p["small"].p50, p["nulls"].n, p["nulls"].p50, p[None].p90) == (700, 1.5, 0, None, 2.0)
    of = cohort.percentile_of(df, ["c"], "v").collect()
    plain = df.createOrReplaceTempView("rows_") or spark.sql("SELECT c, v, cume_dist() OVER (PARTITION BY c ORDER BY v NULLS FIRST) AS percentile FROM rows_").collect()
    assert sorted(map(str, of)) == sorted(map(str, plain))
    top = {r.c: r.m for r in cohort.mean_of_top(df, ["c"], "v", 0.5, "m").collect()}
    assert top["hot"] == pytest.approx(np.sort(own)[-350:].mean()) and top["small"] == 1.5


def test_groups_in_order_over_batches(spark):
    from braidwork.operators import grouped

    rows = [(g, i) for g in range(50) for i in range(g * 7 % 400)]
    df = spark.createDataFrame(rows, "g int, i int").repartition(3)
    work = lambda key, found: [(key[0], *((len(x), x == sorted(x)) for x in [[r[1] for r in found]]).__next__())]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    got = {r.g: (r.n, r.sorted) for r in grouped.in_order(df, ["g"], "i", "g int, n int, sorted boolean", work).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: (g * 7 % 400, True) for g in range(1, 50) if g * 7 % 400}


def test_level_path_to_the_left(spark):
    """A negative zero counts: -0.0 over a negative length is -180 degrees, as numpy and SQL have it."""
    rows = spark.createDataFrame([(0, -2.0, 0.0), (1, 2.0, 0.0), (2, -2.0, 1.0), (3, -2.0, -1.0)], "n int, x double, y double")
    got = [r.a for r in rows.select("n", G.inclination(F.col("x"), F.col("y"), True).alias("a")).orderBy("n").collect()]
    assert got == pytest.approx([float(np.degrees(np.arctan2(-y, x))) for x, y in [(-2.0, 0.0), (2.0, 0.0), (-2.0, 1.0), (-2.0, -1.0)]])
    assert got[0] == -180 and math.copysign(1, got[1]) == 1


def test_heat_map_is_made_once_for_its_peak(spark):
    made = spark.range(1).select(G.peak(G.blob(5, 7, F.col("id"), F.lit(2.0), 1.0), 7).alias("p"))
    assert made._jdf.queryExecution().optimizedPlan().toString().lower().count("exp(") == 1
