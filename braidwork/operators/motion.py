"""Keypoint series: track selection, landmarks, per-frame metrics, path metrics and summaries of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import DIRECT_LANDMARKS
from . import sequence as S

MIN_CONFIDENCE = 0.3
MIN_FRAMES = 20
# Substrings of file names that tell the side, first match first, and target bands of two metrics.
SIDE_BY_NAME = (("lefty", "lefty"), ("righty", "righty"), ("ichiro", "lefty"), ("bautist", "righty"))
ANGLE_BAND, SEPARATION_FLOOR = (5, 20), 25


def select_tracks(keypoints: DataFrame, max_gap: int = 15, mode: str = "gap_or_change") -> DataFrame:
    """The rows of the largest box of each frame (equal areas: the lowest track), with segment_id.

    mode "gap_or_change" debounces identities and also splits on gaps; "change" splits on any change.
    """
    boxes = keypoints.groupBy("video", "frame", "track_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")))
    best = S.top1(boxes.withColumn("area", G.box_columns("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")["area"]), ["video", "frame"], F.desc_nulls_last("area"), F.asc("track_id")).select("video", "frame", "track_id")
    if mode == "change":
        numbered = S.segments(best, ["video"], "frame", "track_id", None)
    else:
        numbered = S.segments(S.debounce(best, ["video"], "frame", "track_id"), ["video"], "frame", "stable_id", max_gap).drop("stable_id")
    return keypoints.join(numbered, ["video", "frame", "track_id"])


def landmarks(keypoints: DataFrame, part: list[str], ordinal: str | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per frame with a struct<x, y> for each landmark, null where no confident keypoint gives it.

    neck and center_hip are the middle of the pair, or the one that is confident. A keypoint given twice counts as its
    last row by ordinal.
    """
    ordinal = ordinal or "confidence"
    names = list(DIRECT_LANDMARKS)
    rows = keypoints.where(F.col("keypoint").isin(names))
    wide = rows.groupBy(*part).pivot("keypoint", names).agg(F.max_by(F.struct("x", "y", "confidence"), ordinal))
    point = {n: F.when(F.col(n)["confidence"] >= min_confidence, F.struct(F.col(n)["x"].alias("x"), F.col(n)["y"].alias("y"))) for n in names}

    def middle(a: str, b: str) -> Column:
        p, q = point[a], point[b]
        both = F.struct(((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"))
        return F.when(p.isNotNull() & q.isNotNull(), both).otherwise(F.coalesce(p, q))

    return wide.select(*part, *(p.alias(n) for n, p in point.items()), middle("left_shoulder", "right_shoulder").alias("neck"), middle("left_hip", "right_hip").alias("center_hip"))


def side_of_name(name: Column, rules: tuple[tuple[str, str], ...] = SIDE_BY_NAME) -> Column:
    out = F.lit(None).cast("string")
    for needle, side in reversed(rules):
        out = F.when(F.lower(name).contains(needle), side).otherwise(out)
    return out


def side_of_travel(marks: DataFrame, part: list[str]) -> DataFrame:
    """(part, side): the side whose ankle moves less; null under 5 places, under 8 pixels or within 15 per cent."""
    agg = marks.groupBy(*part).agg(*(f(F.col(f"{s}_ankle")["x"]).alias(f"{s}_{n}") for s in ("left", "right") for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))))
    left, right = F.col("left_hi") - F.col("left_lo"), F.col("right_hi") - F.col("right_lo")
    clear = (F.col("left_n") >= 5) & (F.col("right_n") >= 5) & (F.greatest(left, right) >= 8)
    return agg.select(*part, F.when(clear & (left > right * 1.15), "righty").when(clear & (right > left * 1.15), "lefty").alias("side"))


def sides(marks: DataFrame, name: str = "video") -> DataFrame:
    """(name, handedness, handedness_source): by name, else by travel, else righty by default."""
    moved = side_of_travel(marks, [name])
    named = side_of_name(F.col(name))
    source = F.when(named.isNotNull(), "filename").when(F.col("side").isNotNull(), "pose").otherwise("default")
    return moved.select(name, F.coalesce(named, "side", F.lit("righty")).alias("handedness"), source.alias("handedness_source"))


def frame_metrics(marks: DataFrame, handedness: str = "handedness") -> DataFrame:
    """Adds hip_shoulder_sep, spine_tilt and front_knee_angle, null where a landmark is missing."""
    c = F.col
    line = lambda a, b: G.line_angle(c(a)["x"], c(a)["y"], c(b)["x"], c(b)["y"])
    knee = {s: G.interior_angle(*(c(f"{s}_{j}")[k] for j in ("hip", "knee", "ankle") for k in ("x", "y"))) for s in ("left", "right")}
    return marks.withColumns({
        "hip_shoulder_sep": G.line_separation(line("left_shoulder", "right_shoulder"), line("left_hip", "right_hip")),
        "spine_tilt": G.tilt_from_vertical(c("neck")["x"] - c("center_hip")["x"], c("neck")["y"] - c("center_hip")["y"]),
        "front_knee_angle": F.when(c(handedness) == "righty", knee["left"]).otherwise(knee["right"]),
    })


def hands(keypoints: DataFrame, part: list[str], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(part, x, y): the mean of the confident wrists; every frame has a row, null without any."""
    good = F.col("keypoint").isin("left_wrist", "right_wrist") & (F.col("confidence") >= min_confidence)
    return keypoints.groupBy(*part).agg(F.avg(F.when(good, F.col("x"))).alias("x"), F.avg(F.when(good, F.col("y"))).alias("y"))


def path_metrics(points: DataFrame, part: list[str], order: str = "frame", smooth: int = 5, max_step: int = 2, signed: bool = False) -> DataFrame:
    """Adds x_s, y_s, attack_angle and speed along a path of points (x, y)."""
    smooth_ = S.centred_mean(points, part, order, ["x", "y"], smooth)
    moved = S.central_velocity(smooth_, part, order, "x_s", "y_s", max_step)
    return moved.withColumn("attack_angle", F.when(F.col("speed").isNotNull(), G.inclination(F.col("vx"), F.col("vy"), signed))).drop("vx", "vy")


def segment_metrics(path: DataFrame, metrics: DataFrame, part: list[str], order: str = "frame") -> DataFrame:
    """One row a segment: n_frames, contact_frame, its metrics, their ranges and a map of all frames' metrics."""
    names = ["hip_shoulder_sep", "spine_tilt", "front_knee_angle", "attack_angle"]
    joined = path.join(metrics, [*part, order], "left")
    contact = S.peak_rows(path, part, order, "speed", MIN_FRAMES).select(*part, F.col(order).alias("contact_frame"))
    rows = joined.join(contact, part, "left")
    at = F.col(order) == F.col("contact_frame")
    return rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.max("contact_frame").alias("contact_frame"),
        F.max(F.when(at, F.struct(*names))).alias("at_contact"),
        *(F.array(F.min(n), F.max(n)).alias(f"{n}_range") for n in names),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(order).cast("string").alias("key"), F.struct(*names, "speed").alias("value"))))).alias("per_frame"),
    )


def long_enough(df: DataFrame, part: list[str], least: int = MIN_FRAMES) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part))).where(f"_n >= {least}").drop("_n")


def joint_metrics(poses: DataFrame, part: list[str], handedness: str = "handedness", order: str = "frame") -> DataFrame:
    """From joints (map of name to struct<x, y, z>): per frame hip_shoulder_sep, lead_elbow_ext, attack_angle_3d, speed, shoulder_tilt."""
    j = lambda n: F.col("joints")[n]
    lead = lambda n: F.when(F.col(handedness) == "righty", j(f"L{n}")).otherwise(j(f"R{n}"))
    rows = poses.withColumns({f"_{a}": (j("LWrist")[a] + j("RWrist")[a]) / 2 for a in "xyz"})
    rows = S.gradient(rows, part, order, ["_x", "_y", "_z"])
    v = tuple(F.col(f"_{a}_g") for a in "xyz")
    return rows.withColumns({
        "hip_shoulder_sep": G.undirected_angle3(G.between3(j("LHip"), j("RHip")), G.between3(j("LShoulder"), j("RShoulder"))),
        "lead_elbow_ext": G.interior_angle3(lead("Shoulder"), lead("Elbow"), lead("Wrist")),
        "attack_angle_3d": G.elevation3(v),
        "speed": F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]),
        "shoulder_tilt": G.elevation3(G.between3(j("LShoulder"), j("RShoulder"))),
    }).drop(*(f"_{a}" for a in "xyz"), *(f"_{a}_g" for a in "xyz"))


def joint_summary(metrics: DataFrame, part: list[str], order: str = "frame") -> DataFrame:
    """One row a segment: contact frame (the fastest, or the middle of a short segment), maxima and values at contact."""
    at = S.peak_rows(metrics, part, order, "speed", MIN_FRAMES, fallback_middle=True)
    at = at.select(*part, F.col(order).alias("contact_frame"), *(F.col(c).alias(f"{c}_at_contact") for c in ("hip_shoulder_sep", "lead_elbow_ext", "attack_angle_3d", "shoulder_tilt")))
    all_ = metrics.groupBy(*part).agg(F.count(F.lit(1)).alias("n_frames"), F.max("hip_shoulder_sep").alias("hip_shoulder_sep_max"), F.max("lead_elbow_ext").alias("lead_elbow_ext_max"))
    return all_.join(at, part)


def in_band(value: Column, low: float = ANGLE_BAND[0], high: float = ANGLE_BAND[1]) -> Column:
    return F.coalesce(value.between(low, high), F.lit(False))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.7, "high").when(value >= 0.5, "medium").otherwise("low")


def coverage(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """Per cent of rows with a value."""
    return df.groupBy(*part).agg((F.avg(F.col(value).isNotNull().cast("int")) * 100).alias("coverage_pct"))


def bat_path(track: DataFrame, fps: float, part: list[str] = ["video"], order: str = "frame") -> DataFrame:  # noqa: B006
    """From a tracked implement (knob, tip, sweet x and y): contact row, its signed attack angle, plane tilt and direction 40 ms back."""
    smooth = S.centred_mean(track, part, order, ["sweet_x", "sweet_y"])
    moved = S.gradient(smooth, part, order, ["sweet_x_s", "sweet_y_s"])
    moved = moved.withColumn("speed", F.hypot("sweet_x_s_g", "sweet_y_s_g"))
    back = S.look_back(moved, part, order, ["sweet_x_s", "sweet_y_s"], max(1, round(0.04 * fps)))
    at = S.peak_rows(back, part, order, "speed", 1)
    angle = G.inclination(F.col("sweet_x_s_g"), F.col("sweet_y_s_g"), signed=True)
    tilt = G.line_angle(F.col("knob_x"), F.col("knob_y"), F.col("tip_x"), F.col("tip_y"))
    direction = G.inclination(F.col("sweet_x_s") - F.col("sweet_x_s_back"), F.col("sweet_y_s") - F.col("sweet_y_s_back"), signed=True)
    found = at.select(*part, F.col(order).alias("contact_frame"), angle.alias("attack_angle_deg"), F.array(*map(F.lit, map(float, ANGLE_BAND))).alias("ideal_band"), in_band(angle).alias("in_ideal_band"), tilt.alias("swing_path_tilt_deg"), direction.alias("attack_direction"))
    return found.join(coverage(track, part, "sweet_x"), part)
