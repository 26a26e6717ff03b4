"""Ordered operators on groups: segmentation, smoothing, differences, peaks, windows. Keys and order are parameters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(part: list[str], *order: str):
    return Window.partitionBy(*part).orderBy(*order)


def top1(df: DataFrame, part: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order, which must break ties."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_by(value: str, ordinal: str) -> Column:
    """A group's first value that isn't null, by ordinal."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(ordinal)))


def shared_groups(df: DataFrame, part: list[str], identity: str) -> DataFrame:
    """Groups with more than one distinct identity, and how many."""
    return df.groupBy(*part).agg(F.countDistinct(identity).alias("n_ids")).where("n_ids > 1")


def debounced(values: list) -> list:
    """Blips of one row, then of two, take the identity around them; each step sees what earlier steps have changed."""
    out = list(values)
    for width in (1, 2):
        for i in range(1, len(out) - width):
            left = out[i - 1]
            if out[i] != left and out[i + width] == left and all(x == out[i] for x in out[i : i + width]):
                out[i : i + width] = [left] * width
    return out


def debounce(df: DataFrame, part: list[str], order: str, identity: str, out: str = "stable_id") -> DataFrame:
    """Adds the debounced identity, as debounced() gives it, by windows alone, for groups of any length.

    A row is a blip of one where it differs from the row before, which the row after equals. Of blips that follow each
    other directly, taking one over heals the next, so every other one is taken, from the first. Blips of two follow
    each other two rows apart, and again every other one is taken.
    """
    w, same = _w(part, order), lambda a, b: a.eqNullSafe(b)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    near = lambda c, n: F.lag(c, -n).over(w)
    df = df.withColumn("_i", F.row_number().over(w))
    blip = (F.col("_i") > 1) & near("_i", 1).isNotNull() & ~same(F.col(identity), near(identity, -1)) & same(near(identity, 1), near(identity, -1))
    df = df.withColumn("_c", blip)
    since = F.col("_i") - F.max(F.when(~F.col("_c"), F.col("_i"))).over(upto)
    df = df.withColumn("_y", F.when(since % 2 == 1, near(identity, -1)).otherwise(F.col(identity)))
    pair = (F.col("_i") > 1) & near("_i", 2).isNotNull() & ~same(F.col("_y"), near("_y", -1)) & same(near("_y", 1), F.col("_y")) & same(near("_y", 2), near("_y", -1))
    df = df.withColumn("_c", pair).withColumns({"_odd": F.col("_i") % 2, "_j": F.floor(F.col("_i") / 2)})
    every = Window.partitionBy(*part, "_odd").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_r", F.col("_c") & ((F.col("_j") - F.coalesce(F.max(F.when(~F.col("_c"), F.col("_j"))).over(every), F.lit(0))) % 2 == 1))
    stable = F.when(F.col("_r"), near("_y", -1)).when(F.coalesce(near("_r", -1), F.lit(False)), near("_y", -2)).otherwise(F.col("_y"))
    return df.withColumn(out, stable).drop("_i", "_c", "_y", "_odd", "_j", "_r")


def segments(df: DataFrame, part: list[str], order: str, identity: str, max_gap: float | None = 15, out: str = "segment_id") -> DataFrame:
    """Adds a segment number from 0: a new one where the identity changes or the order value steps by more than max_gap.

    max_gap None: on change of identity alone.
    """
    w = _w(part, order)
    new = F.col(identity) != F.lag(identity).over(w)
    if max_gap is not None:
        new = new | (F.col(order) - F.lag(order).over(w) > max_gap)
    flag = F.coalesce(new.cast("int"), F.lit(0))
    return df.withColumn("_new", flag).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def segment_summary(df: DataFrame, part: list[str], order: str, identity: str, segment: str = "segment_id") -> DataFrame:
    return df.groupBy(*part, segment).agg(
        F.min_by(identity, order).alias(identity), F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.countDistinct(order).alias("frame_count")
    )


def centred_mean(df: DataFrame, part: list[str], order: str, columns: list[str], width: int = 5, suffix: str = "_s") -> DataFrame:
    """Moving means over rows, partial at the ends. Rows count as valid by the first column alone; a row without any valid
    row in its window stays null."""
    half = width // 2
    w = _w(part, order).rowsBetween(-half, half)
    valid = F.col(columns[0]).isNotNull() & ~F.isnan(columns[0])
    return df.withColumns({c + suffix: F.avg(F.when(valid, F.col(c))).over(w) for c in columns})


def central_velocity(df: DataFrame, part: list[str], order: str, x: str, y: str, max_step: float = 2) -> DataFrame:
    """Adds vx, vy and speed by central differences over the order value, one-sided at the ends; null across larger steps."""
    w = _w(part, order)
    prev_o, next_o = F.coalesce(F.lag(order).over(w), F.col(order)), F.coalesce(F.lead(order).over(w), F.col(order))
    # A missing neighbour means the end; a present neighbour without a place means no velocity.
    has_prev, has_next = F.lag(order).over(w).isNotNull(), F.lead(order).over(w).isNotNull()
    px, py = (F.when(has_prev, F.lag(c).over(w)).otherwise(F.col(c)) for c in (x, y))
    nx, ny = (F.when(has_next, F.lead(c).over(w)).otherwise(F.col(c)) for c in (x, y))
    dt = next_o - prev_o
    good = (F.col(order) - prev_o <= max_step) & (next_o - F.col(order) <= max_step) & (dt > 0)
    df = df.withColumn("vx", F.when(good, (nx - px) / dt)).withColumn("vy", F.when(good, (ny - py) / dt))
    return df.withColumn("speed", F.hypot("vx", "vy"))


def gradient(df: DataFrame, part: list[str], order: str, columns: list[str], suffix: str = "_g") -> DataFrame:
    """Differences by position, unit steps: half the span inside, one-sided at the ends; null for a single row."""
    w = _w(part, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))

    def one(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        first, last = F.lag(order).over(w).isNull(), F.lead(order).over(w).isNull()
        return F.when(n < 2, None).when(first, after - F.col(c)).when(last, F.col(c) - before).otherwise((after - before) / 2)

    return df.withColumns({c + suffix: one(c) for c in columns})


def peak_rows(df: DataFrame, part: list[str], order: str, value: str, min_rows: int = 20, fallback_middle: bool = False) -> DataFrame:
    """Each group's row of the largest value, the first of equals, if the group has min_rows rows.

    Smaller groups give no row, or with fallback_middle the row at position n div 2.
    """
    w = Window.partitionBy(*part)
    ranked = df.withColumns({
        "_n": F.count(F.lit(1)).over(w),
        "_pos": F.row_number().over(w.orderBy(order)) - 1,
        "_best": F.row_number().over(w.orderBy(F.desc_nulls_last(value), F.asc(order))),
    })
    best = (F.col("_n") >= min_rows) & (F.col("_best") == 1) & F.col(value).isNotNull()
    if fallback_middle:
        best = best | ((F.col("_n") < min_rows) & (F.col("_pos") == F.floor(F.col("_n") / 2)))
    return ranked.where(best).drop("_n", "_pos", "_best")


def running_median(df: DataFrame, part: list[str], order: str, value: str, out: str = "running_median") -> DataFrame:
    """Median of all values up to and including the row; null values are passed over.

    Spark has no running median over a frame; a grouped pandas function keeps one in order, and a group fits one task.
    """
    schema = df.withColumn(out, F.lit(None).cast("double")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**{out: pdf[value].astype(float).expanding().median()})

    return df.groupBy(*part).applyInPandas(run, schema)


def trail(df: DataFrame, part: list[str], order: str, columns: list[str], n: int = 10, out: str = "trail") -> DataFrame:
    """The last n rows' columns as an array of structs, oldest first."""
    return df.withColumn(out, F.collect_list(F.struct(*columns)).over(_w(part, order).rowsBetween(-(n - 1), 0)))


def position(df: DataFrame, part: list[str], order: str, out: str = "idx") -> DataFrame:
    return df.withColumn(out, F.row_number().over(_w(part, order)) - 1)


def stacked(df: DataFrame, part: list[str], order: str, column: str, out: str = "stack") -> DataFrame:
    """The values of the row before, the row and the row after; at an end the row stands in for what is missing."""
    w = _w(part, order)
    return df.withColumn(out, F.array(F.coalesce(F.lag(column).over(w), F.col(column)), F.col(column), F.coalesce(F.lead(column).over(w), F.col(column))))


def look_back(df: DataFrame, part: list[str], order: str, columns: list[str], rows: int, suffix: str = "_back") -> DataFrame:
    """Adds each column's value `rows` rows earlier, of the group's first row where there are fewer."""
    w = _w(part, order)
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c + suffix: F.when(F.row_number().over(w) > rows, F.lag(c, rows).over(w)).otherwise(F.first(c).over(first)) for c in columns})


def last_share(df: DataFrame, part: list[str], order: str, share: float = 2 / 3, out: str = "in_zone") -> DataFrame:
    """Whether a row is at or after position floor(n * share) of its group."""
    pos = F.row_number().over(_w(part, order)) - 1
    return df.withColumn(out, pos >= F.floor(F.count(F.lit(1)).over(Window.partitionBy(*part)) * F.lit(share)))


def sampled_positions(df: DataFrame, part: list[str], order: str, shares: tuple[float, ...] = (1 / 6, 1 / 2, 5 / 6), every: int | None = None) -> DataFrame:
    """Rows at the given shares of each group, or every n-th row."""
    pos = F.row_number().over(_w(part, order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    df = df.withColumn("_pos", pos).withColumn("_n", n)
    keep = F.col("_pos") % every == 0 if every else F.exists(F.array(*(F.floor(F.col("_n") * F.lit(s)) for s in shares)), lambda p: p == F.col("_pos"))
    return df.where(keep).drop("_pos", "_n")


def overlapping(df: DataFrame, part: list[str], order: str, length: int, stride: int) -> DataFrame:
    """Rows of windows of `length` positions that begin every `stride` positions from 0: adds window, offset and idx.

    A group no longer than a window gives one, padded alike at both ends; longer groups' last windows are padded with
    their last row. idx is the position of the row that stands there; padded rows repeat it.
    """
    w = Window.partitionBy(*part)
    placed = df.withColumn("idx", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    one = F.col("_n") <= length
    lead = F.floor((length - F.col("_n")) / 2)
    # The windows and offsets that a position fills, its own and, for a first or last position, the padding.
    low = F.when(one, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((F.col("idx") - length + 1) / stride)))
    high = F.when(one, F.lit(0)).otherwise(F.floor(F.col("idx") / stride))
    last = F.floor((F.col("_n") - 1) / stride)
    is_last = F.col("idx") == F.col("_n") - 1
    windows = F.sequence(low.cast("int"), F.when(one, 0).otherwise(F.when(is_last, last).otherwise(high)).cast("int"))
    placed = placed.withColumn("window", F.explode(windows))
    start = F.when(one, -lead).otherwise(F.col("window") * stride)
    own = F.col("idx") - start
    begin = F.when(one & (F.col("idx") == 0), F.lit(0)).otherwise(own)
    end = F.when(is_last, F.lit(length - 1)).otherwise(own)
    return placed.withColumn("offset", F.explode(F.sequence(begin.cast("int"), end.cast("int")))).drop("_n")


def overlap_mean(windows: DataFrame, part: list[str], value: str, length: int, stride: int) -> DataFrame:
    """Each position's mean over all windows that hold it, padding left out: (part, idx, value).

    The rows of a position know their group's length by a window over the group, so that nothing is joined again.
    """
    placed = windows.withColumn("_n", F.max("idx").over(Window.partitionBy(*part)) + 1)
    start = F.when(F.col("_n") <= length, -F.floor((length - F.col("_n")) / 2)).otherwise(F.col("window") * stride)
    return placed.where(start + F.col("offset") == F.col("idx")).groupBy(*part, "idx").agg(F.avg(value).alias(value))


def pivot_names(df: DataFrame, part: list[str], name: str, names: tuple[str, ...], fields: tuple[str, ...], ordinal: str, fill: float | None = 0.0) -> DataFrame:
    """One row a group, one struct column a name: the row of the largest ordinal where a name repeats; missing ones filled."""
    wide = df.groupBy(*part).pivot(name, list(names)).agg(F.max_by(F.struct(*fields), ordinal))
    if fill is None:
        return wide
    blank = F.struct(*(F.lit(fill).alias(f) for f in fields))
    return wide.select(*part, *(F.coalesce(F.col(f"`{n}`"), blank).alias(n) for n in names))


def map_of(df: DataFrame, part: list[str], key: str, fields: tuple[str, ...], out: str) -> DataFrame:
    """Per group, a map from key to a struct of fields; a key must not repeat within a group."""
    return df.groupBy(*part).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*fields).alias("value"))))).alias(out))


def batches(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows [start, end) of the table in order: a slice of a listing, of which each task gives what is below `end`."""
    return df.orderBy(order).offset(start).limit(end - start)


def in_batches(pdfs: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]
