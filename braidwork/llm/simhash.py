"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code on the 64 fingerprint bits: two Golay(23,12) codes, a Hamming(15,11) code and a
Hamming(3,1) code side by side. Each is perfect, with covering radii 3, 3, 1 and 1, so every fingerprint has exactly one
home anchor within radius 8. A fingerprint at most t bits from another lies, block by block, within the block's radius
plus its share of the t bits of the other's home anchor. So each distinct fingerprint goes to its home once and is
replicated to every anchor within covering radius plus threshold (about 165 anchors for t = 2); per anchor, homes are
compared with replicas, and no pair can be missed. There are 2^36 anchors, so few fingerprints meet at one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column, kind_of, materialize, quoted, table, whole_text
from .graph import components

SEED = 42
SHINGLE = 3
THRESHOLD = 2
#: Rows of a batch of shingle hashes whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: 0 without words; of all words together if they are fewer than a shingle."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return of_hashes(np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, max(len(words) - shingle + 1, 1)))


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of the shingles' hashes, repeats included."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


class Block:
    """One perfect code: `columns` are the syndromes of its bits, `radius` its covering radius."""

    def __init__(self, shift: int, columns: list[int], radius: int, threshold: int):
        self.shift, self.bits = shift, len(columns)
        self.syndromes = 1 << max(columns).bit_length()
        half = self.bits // 2
        self.low, self.low_bits = self._spans(columns[:half]), half
        self.high = self._spans(columns[half:])
        self.by_excess = []
        for excess in range(threshold + 1):
            weights = range(radius + 1) if excess == 0 else (radius + excess,)
            found = [(self._xor(columns, at), sum(1 << i for i in at)) for w in weights for at in combinations(range(self.bits), w)]
            found.sort()
            syndromes = np.array([s for s, _ in found], np.int64)
            patterns = np.array([p for _, p in found], np.uint64) << np.uint64(shift)
            counts = np.bincount(syndromes, minlength=self.syndromes)
            self.by_excess.append((counts, np.cumsum(counts) - counts, patterns))

    @staticmethod
    def _xor(columns: list[int], at: tuple[int, ...]) -> int:
        out = 0
        for i in at:
            out ^= columns[i]
        return out

    @staticmethod
    def _spans(columns: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for c in columns:
            out = np.concatenate([out, out ^ c])
        return out

    def syndrome(self, prints: np.ndarray) -> np.ndarray:
        own = (prints >> np.uint64(self.shift)) & np.uint64((1 << self.bits) - 1)
        return self.low[(own & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)] ^ self.high[(own >> np.uint64(self.low_bits)).astype(np.int64)]


def _golay() -> list[int]:
    """Syndromes of the 23 positions: powers of x modulo x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    out, s = [], 1
    for _ in range(23):
        out.append(s)
        s <<= 1
        if s >> 11:
            s ^= 0b101011100011
    return out


def covering_code(threshold: int = THRESHOLD) -> list[Block]:
    return [Block(61, [1, 2, 3], 1, threshold), Block(46, list(range(1, 16)), 1, threshold), Block(0, _golay(), 3, threshold), Block(23, _golay(), 3, threshold)]


def homes(prints: np.ndarray, code: list[Block]) -> np.ndarray:
    out = prints.copy()
    for block in code:
        _, starts, patterns = block.by_excess[0]
        out ^= patterns[starts[block.syndrome(prints)]]
    return out


def replicas(prints: np.ndarray, code: list[Block], threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors that can be home to a fingerprint within threshold of prints[row]."""
    rows, anchors, used = np.arange(len(prints)), prints.copy(), np.zeros(len(prints), np.int8)
    for block in code:
        syndromes, parts = block.syndrome(prints), []
        for excess, (counts, starts, patterns) in enumerate(block.by_excess):
            open_ = np.flatnonzero(used + excess <= threshold)
            s = syndromes[rows[open_]]
            n = counts[s]
            from_ = np.repeat(open_, n)
            within = np.arange(len(from_)) - np.repeat(np.cumsum(n) - n, n)
            parts.append((rows[from_], anchors[from_] ^ patterns[np.repeat(starts[s], n) + within], used[from_] + np.int8(excess)))
        rows, anchors, used = (np.concatenate(x) for x in zip(*parts, strict=True))
    return rows, anchors


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and fp (long, the fingerprint's bits), one row per input row. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(len(keep))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found.view(np.int64))], [*keep, "fp"])

    schema = ", ".join(f"{quoted(c)} {kind_of(docs, c)}" for c in keep)
    return docs.select(*(column(docs, c) for c in keep), whole_text(text).alias("_text")).mapInArrow(run, f"{schema}, fp long")


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in 1 to threshold bits, each once."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = covering_code(threshold)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(homes(own, code).view(np.int64)), batch.column(0)], ["anchor", "a"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = covering_code(threshold)
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 512):
                own = every[at : at + 512]
                rows, anchors = replicas(own, code, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(own[rows].view(np.int64))], ["anchor", "b"])

    at_home = prints.select("fp").mapInArrow(home, "anchor long, a long")
    spread_out = prints.select("fp").mapInArrow(spread, "anchor long, b long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return at_home.hint("shuffle_hash").join(spread_out, "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in `keep`, fp (long) and component_id: the smallest key reachable over links, itself included.

    Null and wordless texts have fingerprint 0 and link like any other. Equal fingerprints are one node, so copies cost
    one row each however many there are; repeated rows keep their rows. An empty table gives an empty one. Null keys
    never become a component_id unless all keys of the component are null. Other input columns are not read, and columns
    may have any names but that `keep` must not name fp or component_id.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(column(docs, key).alias("_key"), F.struct(F.lit(0).alias("_"), *(column(docs, c) for c in keep)).alias("_keep"), whole_text(text).alias("_text"))
    marked = materialize(fingerprints(own, "_text", ("_key", "_keep")), "prints")
    nodes = marked.groupBy("fp").agg(F.min("_key").alias("first")).repartition(parts, "fp")
    nodes = materialize(nodes, "nodes")
    rooted = components(links(nodes.repartition(parts, "fp"), threshold)).withColumnRenamed("node", "fp")
    known = rooted.join(nodes, "fp")
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    joined = materialize(known.join(least, "root").select("fp", "component"), "components")
    of = nodes.join(joined, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return marked.join(of, "fp").select(F.col("_key").alias(key), *(F.col("_keep").getField(c).alias(c) for c in keep), "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
