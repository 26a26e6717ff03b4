"""Gaps in a series of boxes: band joins, a constant-velocity filter, a proxy from wrists, and filling by priority."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_ends
from .grouped import in_order

# The filter's start, process and measurement variances, and a body's proportions.
START_VARIANCE, PROCESS_VARIANCE, MEASURE_VARIANCE = (200.0, 200.0, 500.0, 500.0), (2.0, 2.0, 80.0, 80.0), (20.0, 20.0)
LENGTH_TO_SHOULDERS, LENGTH_WITHOUT, MARGIN, LEAST_NORM = 86 / 47.5, 180.0, 12.0, 5.0


def band_join(rows: DataFrame, bands: DataFrame, on: list[str], value: str, low: str, high: str, width: int | None = None) -> DataFrame:
    """Rows with the bands whose [low, high] holds their value, within equal keys.

    The keys make it an equi-join. With `width`, values are cut into buckets of that size and bands repeated for each
    bucket they touch, so that a key with very many rows is spread as well and no pairs far apart are compared.
    """
    if width is None:
        return rows.join(bands, [*on]).where(F.col(value).between(F.col(low), F.col(high)))
    left = rows.withColumn("_bucket", F.floor(F.col(value) / width))
    right = bands.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.join(right, [*on, "_bucket"]).where(F.col(value).between(F.col(low), F.col(high))).drop("_bucket")


class Filter:
    """A constant-velocity filter in the plane: x, y and their steps a row.

    Both axes have equal variances and nothing in common, so that one covariance of place and step (a, b, c) serves both.
    """

    def __init__(self, x: float, y: float):
        self.x, self.y, self.dx, self.dy = x, y, 0.0, 0.0
        self.a, self.b, self.c = START_VARIANCE[0], 0.0, START_VARIANCE[2]

    def predict(self) -> tuple[float, float]:
        self.x, self.y = self.x + self.dx, self.y + self.dy
        self.a, self.b, self.c = self.a + 2 * self.b + self.c + PROCESS_VARIANCE[0], self.b + self.c, self.c + PROCESS_VARIANCE[2]
        return self.x, self.y

    def update(self, x: float, y: float) -> None:
        place, step = self.a / (self.a + MEASURE_VARIANCE[0]), self.b / (self.a + MEASURE_VARIANCE[0])
        off = x - self.x, y - self.y
        self.x, self.y, self.dx, self.dy = self.x + place * off[0], self.y + place * off[1], self.dx + step * off[0], self.dy + step * off[1]
        self.a, self.b, self.c = self.a - place * self.a, self.b - place * self.b, self.c - step * self.b

    @property
    def state(self) -> tuple[float, float, float, float]:
        return self.x, self.y, self.dx, self.dy

    def held(self) -> list[float]:
        return [self.x, self.y, self.dx, self.dy, self.a, self.b, self.c]

    @classmethod
    def of(cls, held: list[float]) -> Filter:
        out = cls(0.0, 0.0)
        out.x, out.y, out.dx, out.dy, out.a, out.b, out.c = held
        return out


class Gaps:
    """What filling a series holds: the filter, the measured sizes in order, and the rows since the last measurement."""

    def __init__(self, max_gap: int | None = None):
        self.kf, self.widths, self.heights, self.since, self.max_gap = None, [], [], 0, max_gap

    def row(self, x: float | None, y: float | None, w: float | None, h: float | None) -> tuple[float, float, float, float] | None:
        """Takes a row in; for one without a measurement, what is predicted in its place."""
        if x is not None and x == x:
            if self.kf is None:
                self.kf = Filter(x, y)
            else:
                self.kf.predict()
                self.kf.update(x, y)
            insort(self.widths, w)
            insort(self.heights, h)
            self.since = 0
        elif self.kf is not None:
            place = self.kf.predict()
            self.since += 1
            if self.max_gap is None or self.since <= self.max_gap:
                return *place, *((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 for s in (self.widths, self.heights))
        return None


def kalman(frames: DataFrame, part: list[str], order: str = "frame", cx: str = "cx", cy: str = "cy", w: str = "w", h: str = "h", max_gap: int | None = None) -> DataFrame:
    """Predictions (part, order, k_cx, k_cy, k_w, k_h) for rows without a measurement, after the first one.

    Forward only, and without end unless max_gap bounds the rows since the last measurement. Sizes are medians of the
    measured sizes so far, which are kept in order: all that is held of a group.
    """
    fields = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*part, order]) + ", k_cx double, k_cy double, k_w double, k_h double"

    def run(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        gaps = Gaps(max_gap)
        for row in rows:
            if (made := gaps.row(*row[len(part) + 1 :])) is not None:
                yield *key, row[len(part)], *made

    return in_order(frames.select(*part, order, cx, cy, w, h), part, order, schema, run)


def shoulder_lengths(keypoints: DataFrame, part: list[str]) -> DataFrame:
    """(part, length): the implement's length in pixels from the median distance of the shoulders, or a fixed one."""
    side = lambda s, a: F.max(F.when(F.col("keypoint") == f"{s}_shoulder", F.col(a)))
    per = keypoints.groupBy(*part, "frame").agg(F.hypot(side("left", "x") - side("right", "x"), side("left", "y") - side("right", "y")).alias("d"))
    return per.groupBy(*part).agg(F.coalesce(F.median("d") * LENGTH_TO_SHOULDERS, F.lit(LENGTH_WITHOUT)).alias("length"))


def wrist_proxy(marks: DataFrame, length: str = "length", handedness: str = "handedness") -> DataFrame:
    """Adds p_x1, p_y1, p_x2, p_y2, p_cx, p_cy, p_knob_x, p_knob_y, p_tip_x, p_tip_y from the wrists and the top hand's elbow.

    marks has landmarks left_wrist, right_wrist, left_elbow, right_elbow as structs; null where they don't suffice.
    """
    right = F.col(handedness).isin("right", "righty")
    pick = lambda a, b: F.when(right, F.col(a)).otherwise(F.col(b))
    knob, top, elbow = pick("left_wrist", "right_wrist"), pick("right_wrist", "left_wrist"), pick("right_elbow", "left_elbow")
    ex, ey = top["x"] - elbow["x"], top["y"] - elbow["y"]
    blend = F.coalesce(F.hypot(ex, ey) > LEAST_NORM, F.lit(False))
    dx = F.when(blend, 0.5 * (top["x"] - knob["x"]) + 0.5 * ex).otherwise(top["x"] - knob["x"])
    dy = F.when(blend, 0.5 * (top["y"] - knob["y"]) + 0.5 * ey).otherwise(top["y"] - knob["y"])
    df = marks.withColumns({"_kx": knob["x"], "_ky": knob["y"], "_dx": dx, "_dy": dy}).withColumn("_n", F.hypot("_dx", "_dy"))
    good = F.col("_n") >= LEAST_NORM
    df = df.withColumns({"p_knob_x": F.when(good, F.col("_kx")), "p_knob_y": F.when(good, F.col("_ky")), "p_tip_x": F.when(good, F.col("_kx") + F.col("_dx") / F.col("_n") * F.col(length)), "p_tip_y": F.when(good, F.col("_ky") + F.col("_dy") / F.col("_n") * F.col(length))})
    df = df.withColumns({"p_cx": (F.col("p_knob_x") + F.col("p_tip_x")) / 2, "p_cy": (F.col("p_knob_y") + F.col("p_tip_y")) / 2})
    df = df.withColumns({
        "p_x1": F.when(good, F.least("p_knob_x", "p_tip_x") - MARGIN), "p_y1": F.when(good, F.least("p_knob_y", "p_tip_y") - MARGIN),
        "p_x2": F.when(good, F.greatest("p_knob_x", "p_tip_x") + MARGIN), "p_y2": F.when(good, F.greatest("p_knob_y", "p_tip_y") + MARGIN),
    })
    return df.drop("_kx", "_ky", "_dx", "_dy", "_n")


def by_priority(spine: DataFrame, on: list[str], sources: list[tuple[str, DataFrame]], columns: list[str], missing: str = "missing") -> DataFrame:
    """spine with each column from the first source that has the row, and `source`, its name; `missing` where none has it."""
    out = spine
    for name, df in sources:
        out = out.join(df.select(*on, F.struct(*columns).alias(f"_{name}")), on, "left")
    chosen = F.coalesce(*(F.col(f"_{n}") for n, _ in sources))
    source = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n, _ in sources), F.lit(missing))
    return out.withColumn("_c", chosen).select(*spine.columns, *(F.col("_c")[c].alias(c) for c in columns), source.alias("source"))


def looked_up(rows: DataFrame, lookup: DataFrame, on: list[str], columns: list[str], found: str = "found") -> DataFrame:
    """Every row once, with the columns of its key's lookup row and whether there is one. Of a key's repeated lookup rows the
    least by `columns`, nulls first; null keys find nothing."""
    single = lookup.groupBy(*on).agg(F.min(F.struct(*columns)).alias("_l"))
    return rows.join(single, on, "left").select(*(rows[c] if c not in on else c for c in rows.columns), *(F.col(f"_l.{c}").alias(c) for c in columns), F.col("_l").isNotNull().alias(found))


def coverage_pivot(filled: DataFrame, part: list[str], names: list[str], missing: str = "missing") -> DataFrame:
    """Per group, rows of each source, total and per cent not missing."""
    wide = filled.groupBy(*part).pivot("source", names).count().na.fill(0, names)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return wide.withColumn("total", total).withColumn("coverage_pct", F.round((total - F.col(missing)) / total * 100, 1))


def split_members(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is among keys, rows whose key isn't)."""
    return rows.join(keys, on, "left_semi"), rows.join(keys, on, "left_anti")


def histogram(df: DataFrame, part: list[str], value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """(part, bin, n): counts in equal bins from 1; the last bin includes its upper bound."""
    v = F.col(value)
    at: Column = F.least(F.floor((v - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where(v.between(low, high)).groupBy(*part, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def best_box(boxes: DataFrame, part: list[str] = ["video", "frame"], confidence: str = "bat_conf") -> DataFrame:  # noqa: B006
    """The most confident box of each frame, the leftmost of equals."""
    from .sequence import top1

    return top1(boxes, part, F.desc_nulls_last(confidence), F.asc("bat_x1"), F.asc("bat_y1"))


def end_labels(boxes: DataFrame, part: list[str] = ["video", "frame"], confidence: str = "bat_conf", least: float = 0.5) -> DataFrame:  # noqa: B006
    """(part, knob_x, knob_y, tip_x, tip_y) of the boxes that are confident enough; a box without a confidence is."""
    knob, tip = box_ends(*(F.col(f"bat_{c}") for c in ("x1", "y1", "x2", "y2")))
    sure = boxes.where(F.coalesce(F.col(confidence), F.lit(1.0)) >= least)
    return sure.select(*part, *(end[a].alias(f"{name}_{a}") for name, end in (("knob", knob), ("tip", tip)) for a in "xy"))
