"""Near-duplicates of operator 2 at a similarity of 0.8: SimHash fingerprints and MinHash bands propose sets, whole sets decide.

Equal shingle sets are one node. The fingerprints of all nodes are linked by the covering code of simhash.py, and the links that
whole sets bear out are the first components. At a similarity of 0.8, two fingerprints differ in some 10 bits, though; anchors
within covering radius plus 10 are far too many to replicate to, and 2 bits find few such pairs. So bands complete what the
fingerprints find: two sets of similarity s share a band with chance 1 - (1 - s^ROWS)^BANDS, which is 0.9999 at 0.8. Sets that
share a band or are near in fingerprint are candidates; those are joined exactly, by their rarest shingles, and each pair so
proposed is checked on its whole sets, so that no pair below the similarity is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..shared import sent
from .common import column, kind_of, materialize, quoted, whole_text
from .graph import components
from .simhash import THRESHOLD, links, of_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
SEED = 42
#: Rounds in which the nodes of a shingle are held against one of them only.
STARS = 3
#: Bits of a set's bitmap.
BITS = 1024
#: Shingles whose hashes are mixed at once.
BLOCK = 1 << 12
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_XOR, _ODD = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)


def every_shingle(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included: of all words together if they are fewer, 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(s, SEED) for s in parts), np.uint64)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    return np.unique(every_shingle(text, shingle))


def bands(own: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), BLOCK):
        mixed = (own[None, at : at + BLOCK] ^ _XOR) * _ODD
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(1), out=least)
    return [_signed(xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]


def bitmap(own: np.ndarray) -> np.ndarray:
    """A bit for each shingle, at its hash's remainder: two sets differ in at least as many shingles as bits."""
    bits = np.zeros(BITS, np.uint8)
    bits[(own % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rare(sets: DataFrame, similarity: float) -> DataFrame:
    """(at, node, n, u, i): the rarest shingles `at` of each set of n that another set has too, at place i by rarity.

    Two sets that are similar enough share one of the n - ceil(similarity n) + 1 rarest shingles of each, in any one order
    of all shingles: the prefix filter of similarity joins, which is exact. The u shingles that no other set has come
    first and are counted only.
    """
    every = sets.select("node", F.size("own").alias("n"), F.explode("own").alias("at"))
    often = materialize(every.groupBy("at").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    known = every.join(often.hint("merge"), "at").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "at"))).alias("own"))
    u = F.col("n") - F.size("own")
    room = F.greatest(F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - u, F.lit(0)).cast("int")
    return materialize(known.select("node", "n", u.alias("u"), F.posexplode(F.slice("own", 1, room)).alias("i", "x")).select(F.col("x.at").alias("at"), "node", "n", "u", (F.col("i") + F.col("u")).alias("i")), "rare")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole shingle sets are at least that similar."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # The sets asked for are few and long: their numbers are sent to the sets, which are not shuffled to be looked through.
    named = sent(materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "named"))
    asked = materialize(sets.select("node", "own").join(named, "node", "left_semi"), "asked")
    both = pairs.join(asked.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(asked.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links")


def _near_prints(nodes: DataFrame, threshold: int) -> DataFrame:
    """(a, b): nodes whose fingerprints lie within threshold bits by the covering code, the least node standing for those of
    equal fingerprints, and each of these with it."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    of = lambda side: prints.select(F.col("fp").alias(side), F.col("least").alias(f"node_{side}"))
    apart = materialize(links(prints.repartition(parts, "fp"), threshold), "apart").join(of("a"), "a").join(of("b"), "b").select("node_a", "node_b")
    equal = nodes.select("node", "fp").join(prints, "fp").where("node <> least").select("least", "node")
    return materialize(apart.union(equal).toDF("a", "b"), "near")


def _linked(at: DataFrame, sets: DataFrame, similarity: float, near: DataFrame) -> DataFrame:
    """(node, root) for every node of the table of _rare() or of the pairs `near` that proves linked.

    Those pairs of near fingerprints whose whole sets are similar enough are the components to begin with. The nodes that share a rare shingle are first held against one of them, a leader, and those linked are one component: in
    the first round the node with the fewest shingles of its own, as the text that copies were made from has hardly any and is
    closer to each copy than copies are to each other; then others by chance. STARS rounds leave few links unfound. At last, all nodes of a shingle that are in
    different components are held against each other, unless places by rarity or bitmaps leave too few shingles to share
    (both are bounds that no pair similar enough can miss).
    No link between components goes unchecked, and many copies of a text cost their number a round and not its square.
    """
    roots = materialize(components(_verified(near, sets, similarity)), "roots")
    for turn in range(STARS + 1):
        own = at.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = materialize(own.select("at", "node", "n", "u", "i", "root"), "placed")
        chance = F.xxhash64(F.lit(turn), "node", "at") if turn == STARS - 1 else F.xxhash64(F.lit(turn), "node")
        order = F.struct("u", -F.col("n"), chance) if turn == 0 else chance
        if turn < STARS:
            other = own.groupBy("at").agg(F.min(F.struct(order.alias("h"), "node", "n", "u", "i", "root")).alias("x")).select("at", "x.*").drop("h")
        else:
            mixed = materialize(own.groupBy("at").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("at"), "mixed")
            own = other = materialize(own.join(mixed, "at").join(sets.select("node", "bits"), "node").select(*own.columns, "bits"), "apart")
        x, y = own.alias("x"), materialize(other, "others").alias("y")
        c = lambda side, name: F.col(f"{side}.{name}")
        rest = F.least(c("x", "n") - c("x", "i"), c("y", "n") - c("y", "i")) + F.least(c("x", "i") - c("x", "u"), c("y", "i") - c("y", "u"))
        enough = rest * (1 + similarity) >= similarity * (c("x", "n") + c("y", "n")) - 1e-9
        apart = c("x", "root") != c("y", "root") if turn < STARS else c("x", "root") < c("y", "root")
        if turn == STARS:
            unlike = F.aggregate(F.zip_with(c("x", "bits"), c("y", "bits"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
            both = c("x", "n") + c("y", "n")
            enough &= (both - unlike) * (1 + similarity) >= 2 * similarity * both - 1e-9
        pairs = x.join(y, (c("x", "at") == c("y", "at")) & apart & enough).select(c("x", "node").alias("a"), c("y", "node").alias("b"))
        found = _verified(pairs, sets, similarity).union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = materialize(components(found), "roots")
    return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), shingle: int = SHINGLE, similarity: float = SIMILARITY, threshold: int = THRESHOLD) -> DataFrame:
    """key, the columns in `keep` and component_id: the smallest key reachable over pairs of at least that similarity.

    threshold: bits up to which the covering code links fingerprints; what lies further apart is found by bands.

    Keys must be unique, not null and the same at each reading of docs (a written table's). Null counts as the empty text;
    texts without words are equal to each other. An empty table gives an empty one. `keep` must not name node, fp or bands.
    """
    names = [key, *keep]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [every_shingle(t, shingle) for t in batch.column(len(names)).to_pylist()]
            sets = [np.unique(x) for x in every]
            prints = np.fromiter(map(of_hashes, every), np.uint64, len(every)).view(np.int64)
            told = [pa.array(prints), pa.array([_signed(xxh64_intdigest(s.tobytes(), SEED)) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *told], [*names, "fp", "node", "bands"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sets = [shingles(t, shingle) for t in part.column(1).to_pylist()]
                told = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([bitmap(x) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *told], ["node", "own", "bits"])

    schema = ", ".join(f"{quoted(c)} {kind_of(docs, c)}" for c in names)
    marked = materialize(docs.select(*(column(docs, c) for c in names), whole_text(text).alias("_text")).mapInArrow(mark, f"{schema}, fp long, node long, bands array<long>"), "marked")
    nodes = materialize(marked.groupBy("node").agg(F.min(quoted(key)).alias("first"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    every = nodes.select("node", F.explode("bands").alias("band"))
    crowded = sent(materialize(every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "crowded"))
    near = _near_prints(nodes, threshold)
    candidates = every.join(crowded, "band").select("node").union(near.select("a")).union(near.select("b"))
    wanted = sent(materialize(candidates.distinct().join(nodes.select("node", "first"), "node"), "wanted"))
    sets = docs.select(column(docs, key).alias("first"), whole_text(text).alias("_text")).join(wanted, "first").select("node", "_text").mapInArrow(whole, "node long, own array<long>, bits array<long>")
    sets = materialize(sets, "sets")
    rooted = _linked(_rare(sets, similarity), sets, similarity, near).join(nodes.select("node", "first"), "node")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    of = rooted.join(least, "root").select("node", "component_id")
    of = materialize(nodes.select("node", "first").join(of, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")), "components")
    return marked.join(of, "node").select(*map(quoted, names), "component_id")
