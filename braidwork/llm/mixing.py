"""Mixing sources to target weights by temperature.

Each source's share p of all tokens becomes a weight in proportion to p^a. The exponent a in [0, 1] is bisected until the
weights reach a target entropy, given as evenness (entropy over its largest value) or as a share of the way from natural
entropy to the largest, and until no source is repeated more often than allowed.
The weights times the token budget are then realised as permutations of blocks: a source's documents are hashed into
blocks; it is passed over in whole as often as its target holds, and the rest is filled with its blocks in the order of a
keyed permutation, the last one in part.

Nothing is gathered by source: documents are summed by source and block, and only those sums are ordered within a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, column, materialize, packed, table, unpacked, whole_text

SEED = 20_240
#: Blocks to a source, whatever its size: a source's last pass ends within one block, which is then cut by document.
BLOCKS = 1 << 12
#: Sources up to which their decisions, a row each, are sent to every executor; beyond, documents are joined with them by
#: shuffle, each source in SALTS parts.
SENT_ROWS, SALTS = 100_000, 64
#: Exponents tried at once, and rounds: each round narrows the bracket to one of SECTIONS parts.
SECTIONS, ROUNDS = 32, 6
#: The query's target: so far from the sources' natural entropy towards the largest, that of equal weights.
TOWARDS = 0.5
MAX_REPETITION = 4.0


def _own(docs: DataFrame, key: str, source: str, text: str, tokens: str | None) -> DataFrame:
    """docs' rows as _doc, with _key, _source and _tokens (a column's counts, null counting as 0, or else the words)."""
    counted = F.regexp_count(whole_text(text), F.lit(WORD_PATTERN)) if tokens is None else F.coalesce(column(docs, tokens), F.lit(0))
    return docs.select(packed(docs, "_doc"), column(docs, key).alias("_key"), column(docs, source).alias("_source"), counted.cast("long").alias("_tokens"))


def _tagged(docs: DataFrame, seed: int) -> DataFrame:
    """Adds _s (the source, null made empty but told apart), _b (block) and _h (place within it)."""
    s = F.when(F.col("_source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("_source").cast("string")))
    at = F.xxhash64(F.lit(seed), F.col("_key").cast("string"), s)
    return docs.withColumns({"_s": s, "_b": F.pmod(at, F.lit(BLOCKS)).cast("int"), "_h": F.xxhash64(F.lit(seed + 1), F.col("_key").cast("string"), s)})


def temperature(sources: DataFrame, budget: float | None, evenness: float | None, max_repetition: float | None, towards: float | None = None) -> tuple[float, float, float]:
    """(a, Z, tokens): the exponent for sources (tokens long), the sum of shares^a, and the tokens to realise.

    budget: tokens to realise, as a multiple of all tokens. One job a round: for SECTIONS + 1 exponents the sums over all sources are taken at once. Without a budget there are
    as many tokens as let every source be passed over once. Evenness falls and repetition falls as a grows; the smallest
    a in [0, 1] is taken whose evenness is no more than the target and whose largest repetition is within the limit.
    """
    total, count, most = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.max("tokens")).first()
    if not total:
        return 1.0, 1.0, 0.0
    p = F.col("tokens") / F.lit(float(total))

    def tokens(a: float, z: float) -> float:
        return budget * total if budget is not None else z * total / (most / total) ** (a - 1)

    def good(a: float, z: float, zl: float, rare: float) -> bool:
        even = (math.log(z) - a * zl / z) / math.log(count) if count > 1 else 0.0
        repeated = tokens(a, z) * rare / (z * total)
        return (evenness is None or even <= evenness + 1e-12) and (max_repetition is None or repeated <= max_repetition * (1 + 1e-12))

    if towards is not None and count > 1:
        natural = sources.agg(-F.sum(p * F.log(p))).first()[0] / math.log(count)
        evenness = min(1.0, natural + towards * (1 - natural))
    low, high, at_high = 0.0, 1.0, 1.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        a = F.explode(F.array(*map(F.lit, tried))).alias("a")
        sums = sources.select(p.alias("p"), a).groupBy("a").agg(F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.log("p")).alias("zl"), F.max(F.pow("p", F.col("a") - 1)).alias("rare"))
        rows = sorted(map(tuple, sums.collect()))
        found = next((i for i, r in enumerate(rows) if good(*r)), len(rows) - 1)
        high, at_high = rows[found][0], rows[found][1]
        if found == 0:
            break
        low = rows[found - 1][0]
    return high, at_high, tokens(high, at_high)


def plan(docs: DataFrame, budget: float | None, evenness: float | None, max_repetition: float | None, towards: float | None, seed: int) -> tuple[DataFrame, DataFrame, float]:
    """(documents' sizes, decisions by _s, exponent) for documents _key, _source, _tokens.

    A decision: passes (whole passes over the source), last (turn and block that end the partial pass after them; null
    where no block is whole in it), broken (the block that is in it partly) and cut (the largest _h of that block that is).
    """
    sized = materialize(_tagged(docs, seed).select("_key", "_source", "_tokens", "_s", "_b", "_h"), "sizes")
    total = sized.agg(F.sum("_tokens")).first()[0] or 0
    blocks = materialize(sized.groupBy("_s", "_b").agg(F.sum("_tokens").alias("tokens")), "blocks")
    sources = blocks.groupBy("_s").agg(F.sum("tokens").alias("tokens"))
    a, z, tokens = temperature(sources.select("tokens").where("tokens > 0"), budget, evenness, max_repetition, towards)
    share = F.col("all") / F.lit(float(max(total, 1)))
    target = F.lit(tokens) * F.pow(share, F.lit(a)) / F.lit(z)
    of = sources.withColumnRenamed("tokens", "all").where("all > 0").withColumn("target", target)
    of = of.withColumn("passes", F.floor(F.col("target") / F.col("all") + 1e-9).cast("int"))
    of = of.withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target") - F.col("passes") * F.col("all") + 1e-6)).cast("long"))
    turn = F.xxhash64(F.lit(seed), F.col("passes"), F.col("_s"), F.col("_b"))
    upto = Window.partitionBy("_s").orderBy("turn", "_b").rowsBetween(Window.unboundedPreceding, 0)
    ordered = blocks.join(of, "_s", "left").withColumn("turn", turn).withColumn("sum", F.sum("tokens").over(upto))
    # A source without tokens costs nothing: it is passed over once.
    ordered = ordered.select("_s", "_b", "turn", F.coalesce("passes", F.lit(1)).alias("passes"), F.coalesce((F.col("rest") > 0) & (F.col("rest") >= F.col("sum")), F.lit(False)).alias("part"), (F.col("rest") - (F.col("sum") - F.col("tokens"))).alias("room"), F.coalesce("target", F.lit(0.0)).alias("target"))
    ordered = materialize(ordered, "orders")
    # Tokens are never negative, so the blocks in part are a prefix of the order, and at most one block of a source is cut.
    last = F.max(F.when(F.col("part"), F.struct("turn", "_b"))).alias("last")
    told = ordered.groupBy("_s").agg(F.max("passes").alias("passes"), F.max("target").alias("target"), last)
    broken = ordered.where(~F.col("part") & (F.col("room") > 0)).select("_s", "_b", "room")
    upto_h = Window.partitionBy("_s", "_b").orderBy("_h").rangeBetween(Window.unboundedPreceding, 0)
    cuts = sized.join(broken, ["_s", "_b"]).withColumn("sum", F.sum("_tokens").over(upto_h)).where("sum <= room").groupBy("_s", F.col("_b").alias("broken")).agg(F.max("_h").alias("cut"))
    return sized, materialize(told.join(cuts, "_s", "left"), "decisions"), a


def _realised(tagged: DataFrame, decisions: DataFrame, seed: int) -> DataFrame:
    """Rows once for each pass they are in, with epoch."""
    if decisions.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        joined = tagged.join(F.broadcast(decisions), "_s")
    else:
        salted = decisions.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = tagged.withColumn("_salt", F.pmod("_b", F.lit(SALTS))).join(salted, ["_s", "_salt"])
    turn = F.xxhash64(F.lit(seed), F.col("passes"), F.col("_s"), F.col("_b"))
    part = (F.struct(turn.alias("turn"), F.col("_b")) <= F.col("last")) | ((F.col("_b") == F.col("broken")) & (F.col("_h") <= F.col("cut")))
    copies = F.col("passes") + F.coalesce(part, F.lit(False)).cast("int")
    return joined.withColumn("_n", copies).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    budget: float | None = None,
    evenness: float | None = None,
    max_repetition: float | None = None,
    seed: int = SEED,
    towards: float | None = None,
    tokens: str | None = None,
) -> DataFrame:
    """key, source, epoch (0, 1, ...), block, turn, n_tokens, exponent and target (the source's tokens to realise): one row
    for each time a document is used.

    Ordering by epoch, turn and key gives the mixture's order: the blocks of all sources, permuted anew each pass. The
    tokens of a source come to its target less at most one document. tokens names a column of counts, as
    token_counts.count_tokens() gives; without it, words stand for tokens. Null sources are one source; documents with
    equal keys and sources, repeated rows among them, share one fate; null and empty texts have no tokens and follow their
    block; a source without tokens is used once; an empty table gives an empty one. Other columns may have any names.
    """
    sized, decisions, a = plan(_own(docs, key, source, text, tokens), budget, evenness, max_repetition, towards, seed)
    used = _realised(sized, decisions, seed)
    turn = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("_s"), F.col("_b")).alias("turn")
    return used.select(F.col("_key").alias(key), F.col("_source").alias(source), "epoch", F.col("_b").alias("block"), turn, F.col("_tokens").alias("n_tokens"), F.lit(a).alias("exponent"), "target")


def remixed(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    budget: float | None = None,
    evenness: float | None = None,
    max_repetition: float | None = None,
    seed: int = SEED,
    towards: float | None = None,
    tokens: str | None = None,
) -> DataFrame:
    """The rows of docs, each as often as mix() uses it, with docs' own columns only. A row's fate hangs on its key and
    source alone, so reading docs again, in whatever order, gives the same rows."""
    own = _own(docs, key, source, text, tokens)
    _, decisions, _ = plan(own, budget, evenness, max_repetition, towards, seed)
    return unpacked(_realised(_tagged(own.drop("_tokens"), seed), decisions, seed), "_doc")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), max_repetition=MAX_REPETITION, towards=TOWARDS)


QUERIES = {"op9_mixing": op9_mixing}
