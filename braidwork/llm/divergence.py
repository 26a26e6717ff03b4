"""Source divergence audit by mergeable radix tries.

Each task counts its documents' terms in byte tries, one a language, whose leaves count by source. A trie is cut into the
branches of its prefixes; the branches of a prefix meet in one task, grow into one trie, and that is walked in UTF-8 order.
Branches that only one of them has are taken over whole. The walks stream the kept terms to whoever compares sources:
blocks of terms by blocks of sources give partial sums of the pairs and the first candidates of each source.
"""

from __future__ import annotations

import gc
import marshal
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, materialize, table
from .ranks import parts_of

#: A language's documents that must hold a term; candidates that each source is told.
LEAST_DOCS, TOP = 10, 10
#: Parts that a source's shares of terms are told in.
SCALE = 1_000_000_000
#: Counts that a task holds before its tries are written out; bytes of the prefixes whose branches are merged; rows of a batch.
COUNTS, PREFIX, ROWS = 600_000, 3, 4096
#: Terms that sources are compared over at once, about; sources of a block.
TERMS, SOURCES = 2048, 256
#: Letters, and all that is not ASCII, lower-cased where ASCII; all else separates.
_LETTERS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BRANCH = "lang string, prefix binary, branch binary"
_TERM = "lang string, term string, docs long, sources array<string>, counts array<long>"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


class Trie:
    """A radix trie over bytes. A node is [label, children by their first byte, leaf]; a leaf is [documents, counts by source]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.leaves = 0

    def leaf(self, word: bytes) -> list:
        node, at, end = self.root, 0, len(word)
        while at < end:
            children, first = node[1], word[at]
            if first not in children:
                node = children[first] = [word[at:], {}, None]
                break
            node = children[first]
            label = node[0]
            if word.startswith(label, at):
                at += len(label)
            else:
                k = _common(label, word[at:])
                self._split(node, k)
                at += k
        if node[2] is None:
            node[2] = [0, {}]
            self.leaves += 1
        return node[2]

    @staticmethod
    def _split(node: list, k: int) -> None:
        label, children, leaf = node
        node[:] = [label[:k], {label[k]: [label[k:], children, leaf]}, None]

    def merge(self, branch: list) -> None:
        """Adds another trie's branch, which must not be used any more: what this trie lacks is taken over as it is."""
        open_ = [(self.root, branch)]
        while open_:
            own, other = open_.pop()
            k = _common(own[0], other[0])
            if k < len(own[0]):
                self._split(own, k)
            if k < len(other[0]):
                children = {other[0][k]: [other[0][k:], other[1], other[2]]}
            else:
                children = other[1]
                if own[2] is None:
                    own[2] = other[2]
                elif other[2] is not None:
                    own[2][0] += other[2][0]
                    for s, n in other[2][1].items():
                        own[2][1][s] = own[2][1].get(s, 0) + n
            for c, child in children.items():
                if c in own[1]:
                    open_.append((own[1][c], child))
                else:
                    own[1][c] = child

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """(word, leaf) in UTF-8 order."""
        open_ = [(b"", self.root)]
        while open_:
            before, (label, children, leaf) = open_.pop()
            word = before + label
            if leaf is not None:
                yield word, leaf
            open_ += ((word, children[c]) for c in sorted(children, reverse=True))

    def branches(self, n: int) -> Iterator[tuple[bytes, list]]:
        """(prefix, branch) for each prefix of n bytes, and for each shorter word by itself."""
        open_ = [(b"", self.root)]
        while open_:
            before, (label, children, leaf) = open_.pop()
            word = before + label
            if len(word) >= n:
                yield word[:n], [word[n:], children, leaf]
                continue
            if leaf is not None:
                yield word, [b"", {}, leaf]
            open_ += ((word, child) for child in children.values())


def _told(branch: list) -> bytes:
    """A branch as bytes; one that is nested too deeply for marshal, leaf by leaf."""
    try:
        return b"n" + marshal.dumps(branch)
    except ValueError:
        trie = Trie()
        trie.root = [b"", {branch[0][0]: branch} if branch[0] else branch[1], None if branch[0] else branch[2]]
        return b"l" + marshal.dumps(list(trie.walk()))


def _grown(trie: Trie, told: bytes) -> None:
    if told[:1] == b"n":
        trie.merge(marshal.loads(told[1:]))
    else:
        for word, leaf in marshal.loads(told[1:]):
            trie.merge([word, {}, leaf])


@contextmanager
def _without_gc() -> Iterator[None]:
    """Tries have no cycles, but millions of small objects, which the collector would walk through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Branches of the tries of a task's documents (lang, source, text); the leaf of the empty term counts documents.
    Terms are counted by hash first, so that each is followed in its trie but once."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, known in docs.items():
            trie = Trie()
            for word, n in known.items():
                leaf = known[word] = trie.leaf(word)  # in place of the number
                leaf[0] = n
            for (other, source), held in counts.items():
                if other == lang:
                    for word, n in held.items():
                        known[word][1][source] = n
            rows = [(lang, prefix, _told(branch)) for prefix, branch in trie.branches(PREFIX)]
            for at in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + ROWS], strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "prefix", "branch"])
        counts.clear()
        docs.clear()

    with _without_gc():
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    words = terms_of(text)
                    words.append(b"")
                    counts[lang, source].update(words)
                    docs[lang].update(set(words))
                if sum(map(len, counts.values())) >= COUNTS:
                    yield from out()
        yield from out()


def _merged(least_docs: int):
    """Branches in the order of their language and prefix: those of one prefix become one trie, whose terms of enough
    documents are told."""
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def written(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["lang", "term", "docs", "sources", "counts"])

    def terms(lang: str, prefix: bytes, trie: Trie) -> list[tuple]:
        found = ((prefix + word, leaf) for word, leaf in trie.walk() if leaf[0] >= least_docs or not prefix)
        return [(lang, word.decode(), docs, list(counts), list(counts.values())) for word, (docs, counts) in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie, rows = None, Trie(), []
        with _without_gc():
            for batch in batches:
                for lang, prefix, branch in zip(*(batch.column(i) for i in range(3)), strict=True):
                    key = lang.as_py(), prefix.as_py()
                    if at != key:
                        rows += terms(*at, trie) if at else []
                        if len(rows) >= ROWS:
                            yield written(rows)
                            rows = []
                        at, trie = key, Trie()
                    _grown(trie, branch.as_py())
            rows += terms(*at, trie) if at else []
            if rows:
                yield written(rows)

    return run


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) for whole numbers, exact up to totals of 9e15: long division
    by steps of a thousand."""
    below = total + 2 * terms
    rest, out = counts + 2, 0
    for _ in range(3):
        rest = rest * 1000
        digit = rest // below
        rest = rest - digit * below
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


_SUMS = "lang string, source string, part string, item string, value long"


def _compared(terms: pa.Table, info: pa.Table) -> pa.Table:
    """Partial sums of the pairs of two blocks of sources over a range of terms and, where the blocks are one, the first
    candidates of its sources."""
    of = info.to_pydict()
    out: list[tuple] = []
    if not of["source"]:
        return pa.table({n: [] for n in ("lang", "source", "part", "item", "value")}, schema=_SUMS_ARROW)
    lang, v, whole = of["lang"][0], of["v"][0], of["whole"][0]
    i, j = of["i"][0], of["j"][0]
    blocks = [sorted(k for k, b in enumerate(of["block"]) if b == side) for side in (i, j)]
    totals = [np.array([of["n"][k] for k in own], np.int64) for own in blocks]
    names = [[of["source"][k] for k in own] for own in blocks]
    place = [{s: x for x, s in enumerate(own)} for own in names]
    sums = np.zeros([len(x) for x in names], np.int64)
    best: list[list[tuple[int, str]]] = [[] for _ in names[0]]
    terms = terms.filter(pa.compute.not_equal(terms.column("term"), "")).sort_by("term")
    for at in range(0, terms.num_rows if v else 0, TERMS):
        part = terms.slice(at, TERMS)
        words, every = part.column("term").to_pylist(), np.array(part.column("total").to_pylist(), np.int64)
        found = [np.zeros((part.num_rows, len(x)), np.int64) for x in names]
        for row, (sources, counts) in enumerate(zip(part.column("sources").to_pylist(), part.column("counts").to_pylist(), strict=True)):
            for s, n in zip(sources, counts, strict=True):
                for side in (0, 1):
                    if (x := place[side].get(s)) is not None:
                        found[side][row, x] = n
        p, q = (shares(c, t[None, :], v) for c, t in zip(found, totals, strict=True))
        for x in range(len(names[0])):
            sums[x] += apart(p[:, x : x + 1], q).sum(0)
        if i == j:
            common = shares(every, np.int64(whole), v)
            far = apart(p, common[:, None])
            for x in range(len(names[0])):
                own = np.flatnonzero((found[0][:, x] > 0) & (p[:, x] > common))
                own = own[np.argsort(-far[own, x], kind="stable")[:TOP]]  # terms come in UTF-8 order, and so do equals
                best[x] = sorted([*best[x], *((-int(far[y, x]), words[y].encode()) for y in own)])[:TOP]
    for x, a in enumerate(names[0]):
        for y, b in enumerate(names[1]):
            if a != b and (i != j or x < y):
                out += [(lang, a, "pair", b, int(sums[x, y])), (lang, b, "pair", a, int(sums[x, y]))]
        out += [(lang, a, "term", word.decode(), -far_) for far_, word in best[x]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, _SUMS_ARROW, strict=True)], schema=_SUMS_ARROW)


_SUMS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, sources, counts, range): every term of at least that many documents of its language, with its
    counts by source, and for each language the empty term, whose counts are documents. range: the task, whose terms are
    those of some prefixes."""
    plain = lambda c: F.coalesce(column(docs, c).cast("string"), F.lit(""))
    grown = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text")).mapInArrow(_counted, _BRANCH)
    dealt = grown.repartition(parts_of(docs), "lang", "prefix").sortWithinPartitions("lang", "prefix")
    return materialize(dealt.mapInArrow(_merged(least_docs), _TERM).withColumn("range", F.spark_partition_id()), "terms")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value (long) and rank (int), for every (lang, source) that occurs.

    Shares of terms are told in SCALE parts, smoothed by 2. Part `pair`: each other source of the language and the sum
    over its kept terms of (p - q)^2 / (p + q), rounded down term by term; 0 where no term is kept. Part `term`: the terms
    that the source holds more of than its language, by the same measure, ranks up to `top` (TOP at most). Ranks go by
    value, largest first, then by item in UTF-8 order.

    Null text, lang and source count as ''. Documents without terms count as their source's; repeated rows count each
    time. Texts of any length cost their distinct terms; an empty table gives no rows. Columns may have any names, others are not read.
    What meets in one task are the branches of one prefix, however often its terms occur; sums of pairs have a row for each
    pair of sources of a language, as the result has.
    """
    kept = term_counts(docs, text, lang, source, least_docs)
    entry = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    of = entry.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(F.col("term") != "", F.col("n"))), F.lit(0)).alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.when(F.col("term") != "", 1)).alias("v"))
    sizes = of.groupBy("lang").agg(F.sum("n").alias("whole"), F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("blocks"))
    facts = materialize(langs.join(sizes, "lang"), "langs")
    groups = materialize(of.join(facts, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int")), "groups")

    buckets = F.floor(F.col("range") * F.ceil((F.col("v") + 1) / TERMS) / parts_of(docs)).cast("int")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    placed = materialize(kept.join(facts, "lang").select("lang", "term", "sources", "counts", total.alias("total"), "blocks", buckets.alias("bucket")), "placed")
    pairs = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
    terms = pairs(placed).select("lang", "bucket", "i", "j", "term", "sources", "counts", "total")
    # A source's facts go wherever its block meets another and its language has terms.
    met = groups.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    places = materialize(placed.select("lang", "bucket").distinct(), "places")
    info = met.join(places, "lang").select("lang", "bucket", "i", "j", "source", "n", "v", "whole", "block")
    by = ["lang", "bucket", "i", "j"]
    parts = terms.groupBy(*by).cogroup(info.groupBy(*by)).applyInArrow(_compared, _SUMS)
    # A term has one value; a pair's parts are summed.
    summed = materialize(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "summed")
    rank: Column = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= min(top, TOP)))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_divergence": op11_divergence}


def oracle() -> dict:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = lambda c, n: f"1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v)"
    far = "((p - q) * (p - q)) // (p + q)"
    return {
        "op11_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, (SELECT count(*) FROM k WHERE k.lang = l.lang) AS v, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = l.lang) AS whole FROM (SELECT DISTINCT lang FROM g) l),
gt AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "gt.total")} AS p FROM gt JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
q AS (SELECT lang, term, {share("sum(n)", "any_value(whole)")} AS q FROM c JOIN v USING (lang) GROUP BY lang, term, v),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum({far.replace("p", "a.p").replace("q", "b.p")}), 0) AS value FROM g a0 JOIN g b0 ON a0.lang = b0.lang AND a0.source <> b0.source
    LEFT JOIN p a ON a.lang = a0.lang AND a.source = a0.source LEFT JOIN p b ON b.lang = b0.lang AND b.source = b0.source AND b.term = a.term GROUP BY ALL),
fixed AS (SELECT a0.lang, a0.source, b0.source AS item, coalesce((SELECT value FROM pairs x WHERE x.lang = a0.lang AND x.source = a0.source AND x.item = b0.source), 0) AS value FROM g a0 JOIN g b0 ON a0.lang = b0.lang AND a0.source <> b0.source),
told AS (SELECT lang, source, 'pair' AS part, item, value FROM fixed UNION ALL SELECT lang, source, 'term', term, {far} FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM told)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10"""
    }
