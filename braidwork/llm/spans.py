"""Places of pattern matches as DataFrame expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose lengths are summed together; sums of chunks are then summed, so that many matches cost little more than few.
CHUNK = 256


def _running(values: Column) -> Column:
    """Running sums of a short array of longs, led by 0."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def locate(df: DataFrame, text: str, pattern: str, out: str, describe: Callable[[Column, Column, Column], dict[str, Column]], guard: Column | None = None) -> DataFrame:
    """Adds `out`: an array of a struct for each leftmost, non-overlapping match of a Java pattern in column `text`.

    Each has start and end (code points, end exclusive) and what describe(match, text before, text after) gives; before
    and after reach to the neighbouring matches. Where the text is empty, has no match or fails `guard`, the array is empty.
    The text's pieces between the matches give the places: a piece's and a match's length are one step, and steps are
    summed in chunks.
    """
    df = df.withColumn("_m", F.when(F.lit(True) if guard is None else guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    some = F.coalesce(F.size("_m") > 0, F.lit(False))
    df = df.withColumn("_p", F.when(some, F.split(text, pattern)))
    df = df.withColumn("_s", F.zip_with(F.slice("_p", 1, F.size("_m")), "_m", lambda p, m: (F.length(p) + F.length(m)).cast("long")))
    df = df.withColumn("_c", F.when(F.size("_s") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / CHUNK).cast("int")), lambda c: F.slice("_s", c * CHUNK + 1, CHUNK))))
    df = df.withColumn("_q", F.transform("_c", lambda c: F.slice(_running(c), 2, CHUNK)))
    df = df.withColumn("_o", _running(F.transform("_q", lambda q: F.element_at(q, -1))))
    df = df.withColumn("_e", F.flatten(F.zip_with("_q", F.slice("_o", 1, F.size("_q")), lambda q, o: F.transform(q, lambda v: v + o))))

    def one(m: Column, i: Column) -> Column:
        more = describe(m, F.get("_p", i), F.get("_p", i + 1))
        return F.struct((F.get("_e", i) - F.length(m)).alias("start"), F.get("_e", i).alias("end"), *(c.alias(k) for k, c in more.items()))

    found = F.transform("_m", one)
    df = df.withColumn(out, F.when(some, found))
    df = df.withColumn(out, F.coalesce(out, F.slice(F.array(_empty(df, out)), 2, 1)))
    return df.drop("_m", "_p", "_s", "_c", "_q", "_o", "_e")


def _empty(df: DataFrame, out: str) -> Column:
    return F.lit(None).cast(df.schema[out].dataType.elementType)


def numbered(spans: Column, nr: int, kind: str) -> Column:
    """The spans as struct<start, nr, end, kind>, whose order is by start, then by the kind's number."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(nr).alias("nr"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of each struct, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row: the generator keeps later expressions from taking them up, where
    inside a lambda they would be worked out anew for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _before(spans: Column, own: str, others: Column, end: str, own_first: bool) -> Column:
    """For each of `spans`, how many of `others` have their `end` before the span's place `own`; at equal places, the span
    comes first or last. One sort: a place's rank among all less its rank among its own is that number."""
    mark = F.lit(0 if own_first else 1)
    mine = F.transform(spans, lambda s, i: F.struct(s[own].alias("at"), mark.alias("who"), i.alias("id")))
    rest = F.transform(others, lambda s: F.struct(s[end].alias("at"), (1 - mark).alias("who"), F.lit(-1).alias("id")))
    ranked = F.transform(F.array_sort(F.concat(mine, rest)), lambda e, i: F.struct(e["id"].alias("id"), i.alias("i")))
    counted = F.transform(F.filter(ranked, lambda e: e["id"] >= 0), lambda e, j: F.struct(e["id"].alias("id"), (e["i"] - j).alias("n")))
    return F.array_sort(counted)["n"]


def apart(spans: Column, others: Column) -> Column:
    """Those of `spans` that overlap none of `others`, in time that grows with both together."""
    begun, ended = _before(spans, "end", others, "start", True), _before(spans, "start", others, "end", False)
    free = F.zip_with(begun, ended, lambda b, e: b == e)
    marked = F.zip_with(spans, free, lambda s, f: F.struct(s.alias("s"), f.alias("f")))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(F.filter(marked, lambda x: x["f"])["s"])


def within(spans: Column, others: Column) -> Column:
    """For each of `spans`, whether any of `others` reaches into the stretch from its `low` to its `high`, ends included: those
    that begin by its high less those that end before its low, in time that grows with both together."""
    begun, ended = _before(spans, "high", others, "start", False), _before(spans, "low", others, "end", True)
    return F.zip_with(begun, ended, lambda b, e: b > e)


def with_breaks(spans: Column, gap: int) -> Column:
    """Spans by start as struct<s, e, new>: e is the furthest end before the span (the end of that rank, wherever it
    matters), new tells whether the span starts more than `gap` after it."""
    ends = F.array_sort(spans["end"])
    shifted = F.concat(F.array(F.lit(None).cast("long")), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))).cast("array<long>"))
    return F.zip_with(spans, F.slice(shifted, 1, F.size(spans)), lambda s, e: F.struct(s.alias("s"), e.alias("e"), F.coalesce(s["start"] - e > gap, F.lit(True)).alias("new")))


def merged(spans: Column) -> Column:
    """The stretches (struct<start, end>) that spans, by start, cover; those that only touch stay apart."""
    breaks = F.filter(with_breaks(spans, -1), lambda x: x["new"])
    ends = F.concat(F.slice(breaks["e"], 2, F.greatest(F.size(breaks) - 1, F.lit(0))), F.array(F.array_max(spans["end"]).cast("long")))
    return F.zip_with(breaks["s"]["start"], F.slice(ends, 1, F.size(breaks)), lambda s, e: F.struct(s.cast("long").alias("start"), e.alias("end")))
