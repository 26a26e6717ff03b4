"""The streaming forms: running standings, sessions by gap or identity, a stateful filter, and idempotent keyed output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import standings as S
from ..operators.fill import Filter, Gaps


def running_totals(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Sums by team over a stream of games; write it in complete mode. Invalid games are left out."""
    return S.totals(S.sides(S.checked(games, teams).where("error IS NULL")))


def write_standings(games: DataFrame, teams: DataFrame, path: str, checkpoint: str):
    """Starts the stream: after each micro-batch the whole ranking is written anew."""

    def put(batch: DataFrame, _: int) -> None:
        S.standings(batch, teams).write.mode("overwrite").parquet(path)

    return running_totals(games, teams).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions by inactivity: (key, start, end, n). Rows later than `late` behind the newest are dropped by the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.session_window(F.col(ts), gap)
    return timed.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _ordered(pdfs: Iterator[pd.DataFrame], order: str | list[str]) -> pd.DataFrame:
    """All rows of a key in a micro-batch, which may come in several batches, by `order`."""
    every = [pdf for pdf in pdfs if len(pdf)]
    if not every:
        return pd.DataFrame()
    rows = every[0] if len(every) == 1 else pd.concat(every)
    if len(rows) == 1 or isinstance(order, str) and rows[order].is_monotonic_increasing:
        return rows
    return rows.sort_values(order, kind="stable")


def segment_stream(rows: DataFrame, key: str, order: str, identity: str, max_gap: int = 15) -> DataFrame:
    """(key, order, identity, segment_id) for rows that come in order within a key: a new segment on a change of identity or
    a larger step. State per key: the last order value, identity and segment."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{identity}` {kinds[identity]}, segment_id int"
    state = f"last {kinds[order]}, id {kinds[identity]}, segment int"

    def run(_, pdfs: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last, id_, segment = held.get if held.exists else (None, None, 0)
        if len(pdf := _ordered(pdfs, order)):
            found = []
            for at, who in zip(pdf[order].tolist(), pdf[identity].tolist(), strict=True):
                if last is not None and (who != id_ or at - last > max_gap):
                    segment += 1
                last, id_ = at, who
                found.append(segment)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], identity: pdf[identity], "segment_id": np.array(found, np.int32)})
        if last is not None:
            held.update((last, id_, segment))

    return rows.select(key, order, identity).groupBy(key).applyInPandasWithState(run, out, state, "append", "NoTimeout")


def filter_stream(rows: DataFrame, key: str, order: str, x: str = "cx", y: str = "cy") -> DataFrame:
    """(key, order, k_cx, k_cy): the filter's place after each row, measured or not, once there was a measurement."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, k_cx double, k_cy double"

    def run(_, pdfs: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        kf = None
        if held.exists:
            kf = Filter.of(held.get[0])
        if len(pdf := _ordered(pdfs, order)):
            made = []
            for k, o, px, py in pdf[[key, order, x, y]].itertuples(index=False, name=None):
                measured = px is not None and px == px
                if kf is None and not measured:
                    continue
                if kf is None:
                    kf = Filter(px, py)
                else:
                    kf.predict()
                    if measured:
                        kf.update(px, py)
                made.append((k, o, kf.x, kf.y))
            yield pd.DataFrame(made, columns=[key, order, "k_cx", "k_cy"])
        if kf is not None:
            held.update((kf.held(),))

    return rows.select(key, order, x, y).groupBy(key).applyInPandasWithState(run, out, "state array<double>", "append", "NoTimeout")


def fill_stream(rows: DataFrame, key: str, order: str, cx: str = "cx", cy: str = "cy", w: str = "w", h: str = "h") -> DataFrame:
    """kalman() over a stream of rows that come in order within a key: (key, order, k_cx, k_cy, k_w, k_h). State per key: the
    filter's seven numbers and the measured sizes in order."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, k_cx double, k_cy double, k_w double, k_h double"

    def run(_, pdfs: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        gaps = Gaps()
        if held.exists:
            state, widths, heights = held.get
            gaps.kf, gaps.widths, gaps.heights = Filter.of(state) if len(state) else None, list(widths), list(heights)
        made = []
        if len(pdf := _ordered(pdfs, order)):
            for k, o, *box in pdf[[key, order, cx, cy, w, h]].itertuples(index=False, name=None):
                if (found := gaps.row(*box)) is not None:
                    made.append((k, o, *found))
        held.update((gaps.kf.held() if gaps.kf else [], gaps.widths, gaps.heights))
        yield pd.DataFrame(made, columns=[key, order, "k_cx", "k_cy", "k_w", "k_h"])

    return rows.select(key, order, cx, cy, w, h).groupBy(key).applyInPandasWithState(run, out, "state array<double>, widths array<double>, heights array<double>", "append", "NoTimeout")


class Closer(StatefulProcessor):
    """Segments that end by a change of identity, by a gap, or by a timer once the watermark has passed the gap."""

    def __init__(self, key: str, ts: str, order: str, identity: str, gap_ms: int):
        self.key, self.ts, self.order, self.identity, self.gap = key, ts, order, identity, gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "identity string, start long, end long, n long")

    def _timer(self, segment: tuple) -> int:
        return segment[2] // 1000 + self.gap + 1

    def _told(self, key, rows: list[tuple]) -> pd.DataFrame:
        at = lambda i: np.array([r[i] for r in rows], "datetime64[us]")
        return pd.DataFrame({self.key: [key] * len(rows), "identity": [r[0] for r in rows], "start": at(1), "end": at(2), "n": [r[3] for r in rows]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, done = self.open.get() if self.open.exists() else None, []
        pdf = _ordered(rows, [self.ts, self.order])
        if not len(pdf):
            return
        set_ = self._timer(now) if now else None
        for ts, who in zip(pdf[self.ts].to_numpy().astype("datetime64[us]").astype("int64").tolist(), pdf[self.identity].tolist(), strict=True):
            if now and (who != now[0] or ts - now[2] > self.gap * 1000):
                done.append(now)
                now = None
            now = (who, now[1], ts, now[3] + 1) if now else (who, ts, ts, 1)
        # An open segment has one timer, told by its end: there is no need to list those of the key
        if set_ is not None:
            self.handle.deleteTimer(set_)
        self.open.update(tuple(now))
        self.handle.registerTimer(self._timer(now))
        if done:
            yield self._told(key[0], done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            now = tuple(self.open.get())
            self.open.clear()
            yield self._told(key[0], [now])

    def close(self) -> None:
        pass


def closed_segments(rows: DataFrame, key: str, ts: str, order: str, identity: str, gap_ms: int, late: str) -> DataFrame:
    """(key, identity, start, end, n) of each segment, once: when a row of the key ends it, or else when the watermark, `late`
    behind the newest row of all, has passed its last row by the gap. Rows behind the watermark are dropped.

    Rows of a key come in order of `ts`, then `order`, from one micro-batch to the next. Needs the RocksDB state store.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}[key]
    timed = rows.select(key, F.col(ts).cast("timestamp").alias(ts), order, F.col(identity).cast("string").alias(identity)).withWatermark(ts, late)
    return timed.groupBy(key).transformWithStateInPandas(Closer(key, ts, order, identity, gap_ms), f"`{key}` {kind}, identity string, start timestamp, end timestamp, n long", "append", "EventTime")


def write_by_key(rows: DataFrame, path: str, checkpoint: str, key: str, after: Callable[[int], None] | None = None):
    """Starts a stream that writes each micro-batch to a folder of its own by number, so that a batch that is repeated, as
    it was written but not committed, replaces itself: each row is read once. after: called between write and commit."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").partitionBy(key).parquet(f"{path}/batch={n}")
        if after:
            after(n)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
