"""Document fingerprints by prefix polynomial hashes.

The prefix arrays of a text hold, for each place, the hash of all code points before it, modulo a prime, under two bases.
From them the hash of any span takes one subtraction: spans are compared in constant time, the longest common extension
from two places is found by binary search, and the hashes of all windows of a text are two array operations. A fingerprint
is a text's length, its whole hash and the least hashes of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, kind_of, materialize, quoted, table, whole_text
from .ranks import parts_of

PRIME = (1 << 31) - 1
BASES = (1_000_003_411, 1_876_543_289)
#: Code points of a window, half the text's at most; windows whose hashes a fingerprint keeps; bytes of each.
WINDOW, LEAST, BYTES = 12, 32, 6
#: Code points that are worked on at once; rows of a batch that are.
CHUNK, ROWS = 1 << 18, 64
_P = np.uint64(PRIME)
_S = np.uint64(31)
_POWERS: list[np.ndarray] = []


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, a Mersenne prime: the upper bits are added to the lower ones."""
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of both bases, then of their inverses; kept, and grown by doubling."""
    if not _POWERS or len(_POWERS[0]) < n:
        room = max(1 << 12, 1 << (n - 1).bit_length())
        grown = []
        for base in (*BASES, *(pow(b, -1, PRIME) for b in BASES)):
            out, filled = np.ones(room, np.uint32), 1
            while filled < room:
                step = np.uint64(pow(base, filled, PRIME))
                out[filled : 2 * filled] = _folded(out[:filled].astype(np.uint64) * step)
                filled *= 2
            grown.append(out)
        _POWERS[:] = grown
    return _POWERS


class Prefixes:
    """The prefix arrays of a text: 12 bytes a code point, its own 4 included."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(self.codes)
        self.sums = [np.zeros(self.n + 1, np.uint32) for _ in BASES]
        powers = _powers(self.n)
        for sums, power in zip(self.sums, powers, strict=False):
            before = np.uint64(0)
            for at in range(0, self.n, CHUNK):
                codes = self.codes[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
                run = _folded(np.cumsum(_folded(codes * power[at : at + len(codes)])) + before)
                sums[at + 1 : at + 1 + len(codes)] = run
                before = run[-1]

    def span(self, start: int, end: int) -> int:
        """The hash of the code points from start to end, wherever in a text they stand."""
        out = 0
        for k, sums in enumerate(self.sums):
            out = out << 31 | (int(sums[end]) - int(sums[start])) * int(_powers(start + 1)[2 + k][start]) % PRIME
        return out

    def extension(self, start: int, other: Prefixes, at: int = 0) -> int:
        """How many code points from `start` on equal those of other from `at` on, by binary search over equal spans."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(at, at + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def windows(self) -> Iterator[np.ndarray]:
        """The mixed hashes of all windows, in chunks."""
        width = max(min(WINDOW, self.n // 2), 1)
        n = self.n - width + 1
        inverse = _powers(self.n)[2:]
        for at in range(0, n, CHUNK):
            end, out = min(at + CHUNK, n), np.uint64(0)
            for sums, back in zip(self.sums, inverse, strict=True):
                rise = sums[at + width : end + width].astype(np.uint64) + _P - sums[at:end]
                out = out << _S | _folded(_folded(rise) * back[at:end])
            yield _mixed(out)

    def fingerprint(self) -> bytes:
        """Eight bytes of length, eight of the whole hash, then the least distinct window hashes in order, BYTES bytes each."""
        least = np.zeros(0, np.uint64)
        for found in self.windows():
            k = 2 * LEAST
            while True:  # the least hashes may repeat: enough of them are taken for LEAST distinct ones
                some = found if len(found) <= k else np.partition(found, k)[:k]
                if len(some) == len(found) or len(np.unique(some)) >= LEAST:
                    break
                k *= 4
            least = np.unique(np.concatenate([least, some]))[:LEAST]
        return self.n.to_bytes(8) + self.span(0, self.n).to_bytes(8) + least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of BYTES bytes whose order is by chance."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(64 - 8 * BYTES)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: 1 for equal fingerprints, else the estimated share of windows that both texts have among all of theirs."""
    if a == b:
        return 1.0
    x, y = ({p[i : i + BYTES] for i in range(16, len(p), BYTES)} for p in (a, b))
    least = sorted(x | y)[:LEAST]
    return sum(w in x and w in y for w in least) / len(least) if x and y else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last third, rounded down, replaced by as many code points from the start of the other, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_TOLD = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, common_next long"
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]


class _Read:
    """A document's text and what is worked out once of it."""

    def __init__(self, text: str):
        self.text, self.sums = text, Prefixes(text)
        self.print = self.sums.fingerprint()

    def beside(self, following: _Read) -> tuple:
        changed = edited(self.text, following.text)
        other = Prefixes(changed).fingerprint() if changed != self.text else self.print
        near = likeness(self.print, other), likeness(self.print, following.print)
        return self.sums.n, hashlib.sha256(changed.encode()).digest(), self.print, other, *near, self.sums.extension(0, following.sums)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: key, the columns in `keep`, n_chars, fingerprint (binary), those of the text as edited() with
    the next document's (edited_fingerprint, edited_sha256), likeness to both, and common_next: how many code points
    the text and the next one share from the start.

    The next document is that of the next smaller key, after the last the first. Null keys come last. Rows of equal
    keys come in the order of xxhash64 of their texts; equal rows are interchangeable. Null texts count as empty; an empty
    text is like no text but an empty one. Very long texts take 12 bytes a code point besides themselves. Of a single row
    the next one is itself; an empty table gives an empty one. Columns may have any names but the ones that are added.

    Rows are dealt by ranges of the key and read in order, so that each task meets a document and its next one but at its
    end; the first and last texts of each task, one of each, are joined afterwards.
    """
    names, own = [key, *keep], docs.select(column(docs, key).alias("_key"), F.struct(*(column(docs, c) for c in (key, *keep))).alias("_keep"), whole_text(text).alias("_text"))
    order = [F.col("_key").desc_nulls_last(), F.col("_hash"), F.col("_place")]
    hashed = own.select("*", F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    dealt = hashed.repartitionByRange(parts_of(docs), *order).sortWithinPartitions(*order).select("_keep", "_text", F.spark_partition_id().alias("_part"))
    kept = ", ".join(f"{quoted(c)}: {kind_of(docs, c)}" for c in names)
    schema = f"_keep struct<{kept}>, _part int, _role string, _text string, {_TOLD}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for keep_, text_, part_ in zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    now = keep_, part_, _Read(text_)
                    rows.append((keep_, part_, "first", text_) if last is None else (*last[:2], "done", None, *last[2].beside(now[2])))
                    last = now
                yield _table(rows, part.schema)
        if last:
            yield _table([(*last[:2], "last", last[2].text)], batch.schema)

    def _table(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*(r + (None,) * (11 - len(r)) for r in rows), strict=True))
        types = [like.field(0).type, pa.int32(), pa.string(), pa.string(), *_TYPES]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_keep", "_part", "_role", "_text", *(x.split()[0] for x in _TOLD.split(", "))])

    read = materialize(dealt.mapInArrow(run, schema), "in-order")
    firsts = read.where("_role = 'first'").select("_part")
    following = firsts.select("_part", F.lead("_part").over(Window.orderBy("_part")).alias("_next"), F.min("_part").over(Window.partitionBy()).alias("_least"))
    ends = read.where("_role = 'last'").join(following.select("_part", F.coalesce("_next", "_least").alias("_next")), "_part").select("_next", "_keep", "_text")
    pairs = ends.join(read.where("_role = 'first'").select(F.col("_part").alias("_next"), F.col("_text").alias("_other")), "_next").select("_keep", "_text", "_other")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a, b = (batch.column(i)[at].as_py() for i in (1, 2))
                told = _Read(a).beside(_Read(b))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), *(pa.array([v], t) for v, t in zip(told, _TYPES, strict=True))], ["_keep", *(x.split()[0] for x in _TOLD.split(", "))])

    added = [x.split()[0] for x in _TOLD.split(", ")]
    every = read.where("_role = 'done'").select("_keep", *added).unionByName(pairs.mapInArrow(end, f"_keep struct<{kept}>, {_TOLD}"))
    return every.select(*(F.col("_keep").getField(c).alias(c) for c in names), *added)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_next(table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next", "common_next")


QUERIES = {"op13_fingerprints": op13_fingerprints}
