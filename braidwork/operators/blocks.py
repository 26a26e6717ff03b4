"""Keyword search over postings in blocks by impact: what cannot reach the k best brings no candidates.

A posting's impact is its part of the score but for the term's weight. Documents are dealt to shards of a bounded number of
words, and a shard's postings are packed where its words are counted: they are never shuffled. A term's postings in a shard
are packed in blocks of nearly equal impact, with a bound of the largest kept beside the block. A first look at each query's
heaviest terms gives k documents a shard, whose whole scores the k best reach at least. Terms that cannot reach that score all
together, the common ones, bring no candidates; of the others, blocks that cannot reach it with all that other terms may add
are skipped. Only for the candidates that are left are the other terms looked up. Of the index, what moves are the blocks of
the terms asked for, each to its shard's task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..shared import written
from .retrieval import K1, B, _all, ranked, term_weights
from .retrieval import _blocks as some_at_once

#: Postings of a block, at most; terms of a query that the first look takes.
BLOCK, FIRST = 512, 8
#: Words and documents of a shard, about: a task holds one at a time, and a longer document is one of its own.
SHARD = 2_000_000
#: Queries that are sent to every task at once.
ASKED = 5_000


@dataclass
class Blocks:
    """blocks: shard, term, n, least and typical (see _top()), at and tf (arrays: the document's place in its shard, the
    occurrences), doc; a shard's row of the empty term has its documents in doc and their words in tf. heads: shard, term,
    top, n; terms: term, idf; mean: words of a document."""

    blocks: DataFrame
    heads: DataFrame
    terms: DataFrame
    mean: float


def _top(mean: float) -> Column:
    """A bound of a block's impacts, which are (K1 + 1) / (1 + cost): least is the least cost at a mean length of `typical`."""
    return (K1 + 1) / (1 + F.col("least") * F.least(F.lit(1.0), F.col("typical") / mean))


def _shard(number: int, docs: pa.Array, words: pa.ListArray, most: int) -> pa.RecordBatch:
    """The rows of the shard of these documents, by term, each term's blocks of `most` postings by impact and a block's
    documents in order."""
    dl, coded = np.diff(words.offsets.to_numpy()), words.flatten().dictionary_encode()
    places = np.empty(len(coded.dictionary), "int64")
    places[order := pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(places))
    key, tf = np.unique(places[coded.indices.to_numpy()] * len(docs) + np.repeat(np.arange(len(docs)), dl), return_counts=True)
    term, at = np.divmod(key, len(docs))
    typical = max(1.0, dl.mean())
    cost = K1 * (1 - B + B * dl[at] / typical) / tf
    first = np.flatnonzero(np.diff(term, prepend=-1))
    n = np.diff(first, append=len(term))
    many = np.flatnonzero(np.repeat(n, n) > most)
    by_cost = many[np.lexsort((cost[many], term[many]))]
    block = (np.arange(len(term)) - np.repeat(first, n)) // most
    by_cost = by_cost[np.lexsort((at[by_cost], block[many], term[many]))]
    at[many], tf[many], cost[many] = at[by_cost], tf[by_cost], cost[by_cost]
    start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=0) != 0))
    ends, rows = np.append(start, len(term)), len(start)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[0, ends + x[0]], "int32"), pa.array(np.concatenate(x[1:]), "int32"))
    own = {
        "shard": pa.array(np.full(rows + 1, number)),
        "term": pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(order[term[start]]))]),
        "n": pa.array(np.r_[len(docs), np.diff(ends)], "int32"),
        "least": pa.array(np.r_[0.0, np.minimum.reduceat(cost, start) if rows else []]),
        "typical": pa.array(np.full(rows + 1, typical)),
        "at": lists((0, at)),
        "tf": lists((len(docs), dl, tf)),
        "doc": pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(rows + 1, len(docs))], "int32"), docs),
    }
    return pa.RecordBatch.from_pydict(own)


def _packed(batches: Iterator[pa.RecordBatch], most: int, words: int) -> Iterator[pa.RecordBatch]:
    """The shards of about so many words of a task's rows (document, array of its words)."""
    part, held, size, number = TaskContext.get().partitionId(), [], 0, 0

    def shard() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        return _shard((part << 32) + number, *(c.chunk(0) for c in whole.columns), most)

    for batch in batches:
        while batch.num_rows:
            sizes = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy() + 1)
            cut = min(int(np.searchsorted(sizes, words - size)) + 1, batch.num_rows)
            held.append(batch.slice(0, cut))
            size += int(sizes[cut - 1])
            batch = batch.slice(cut)
            if size >= words:
                yield shard()
                held, size, number = [], 0, number + 1
    if held:
        yield shard()


def _kept(words: DataFrame, doc: str, path: str) -> DataFrame:
    """The blocks of rows (doc, array of words), one a document, as a table under `path`."""
    kind = words.schema[doc].dataType.simpleString()
    ddl = f"shard long, term string, n int, least double, typical double, at array<int>, tf array<int>, doc array<{kind}>"
    words.mapInArrow(partial(_packed, most=BLOCK, words=SHARD), ddl).write.mode("overwrite").parquet(path)
    return words.sparkSession.read.parquet(path)


def _index(blocks: DataFrame, terms: DataFrame, mean: float | None) -> Blocks:
    mean = mean or 1.0
    return Blocks(blocks, blocks.where("term <> ''").select("shard", "term", _top(mean).alias("top"), "n"), terms, mean)


def build(docs: DataFrame, doc: str, text: str, path: str) -> Blocks:
    """The blocks of documents, as tables under `path`: a text moves once, and its postings are written where its words are
    counted. Rows of one number are one document, as in word_counts()."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(doc, text).repartition(parts, doc).groupBy(doc).agg(tokens(F.array_join(F.collect_list(text), " ")).alias("words"))
    blocks = _kept(whole, doc, f"{path}/blocks")
    lengths = blocks.where("term = ''").select(F.explode("tf").alias("dl"))
    found = blocks.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
    term_weights(found, lengths.agg(F.count(F.lit(1)).alias("n"))).write.mode("overwrite").parquet(f"{path}/terms")
    return _index(blocks, docs.sparkSession.read.parquet(f"{path}/terms"), lengths.agg(F.avg("dl")).first()[0])


def pack(index: tuple[DataFrame, DataFrame, DataFrame], doc: str, path: str) -> Blocks:
    """The blocks of an index at hand, of postings (term, doc, tf), lengths (doc, dl) and terms (term, idf), as a table under
    `path`. Its postings move to their documents; build() goes without."""
    postings, lengths, terms = index
    said = postings.groupBy(doc).agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("words"))
    words = lengths.select(doc).join(said, doc, "left").select(doc, F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    return _index(_kept(words, doc, path), terms, lengths.agg(F.avg("dl")).first()[0])


class _Shard:
    """A shard's blocks of the terms asked for."""

    def __init__(self, rows: pa.Table, mean: float) -> None:
        self.term, self.mean = rows.column("term").to_pylist(), mean
        own = self.term.index("")
        at, tf, docs = (rows.column(c).combine_chunks() for c in ("at", "tf", "doc"))
        at, tf, docs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (at, tf, docs))
        self.docs = docs.slice(own, 1).flatten()
        self.valid = self.docs.is_valid().to_numpy(zero_copy_only=False)
        dl = tf.slice(own, 1).flatten().to_numpy()
        self.norm = K1 * (1 - B + B * dl / mean)
        self.at, self.tf = at, tf
        self.top = (K1 + 1) / (1 + rows.column("least").to_numpy() * np.minimum(1.0, rows.column("typical").to_numpy() / mean))
        self.rows = defaultdict(list)
        for i, term in enumerate(self.term):
            self.rows[term].append(i)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of a block."""
        if i not in self.held:
            at, tf = self.at.slice(i, 1).flatten().to_numpy(), self.tf.slice(i, 1).flatten().to_numpy()
            self.held[i] = at, tf * (K1 + 1) / (tf + self.norm[at])
        return self.held[i]

    def looked_up(self, term: str, places: np.ndarray) -> np.ndarray:
        """The term's impacts in the documents at these places, 0 where it is missing."""
        out = np.zeros(len(places))
        for i in self.rows.get(term, ()):
            at, impact = self.block(i)
            found = np.minimum(np.searchsorted(at, places), len(at) - 1)
            out += np.where(at[found] == places, impact[found], 0.0)
        return out

    def best(self, places: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best places by rounded score, then by document."""
        if len(score) > k:
            near = score >= np.partition(score, -k)[-k] - 1e-8
            places, score = places[near], score[near]
        score = np.round(score, 9)
        names = self.docs.take(pa.array(places)).to_numpy(zero_copy_only=False)
        order = np.lexsort((np.unique(names, return_inverse=True)[1].ravel(), -score))[:k]
        return places[order], score[order]


def _first_look(own: _Shard, terms: list[str], at: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """k documents that the query's heaviest terms score best, with their whole scores."""
    heaviest = sorted(range(len(terms)), key=lambda i: (-at["most"][i], terms[i]))
    score, seen = np.zeros(len(own.docs)), np.zeros(len(own.docs), bool)
    for i in heaviest[:FIRST]:
        for b in own.rows.get(terms[i], ()):
            place, impact = own.block(b)
            score[place] += at["weight"][i] * impact
            seen[place] = True
    places, _ = own.best(np.flatnonzero(seen & own.valid), score[seen & own.valid], k)
    whole = score[places]
    for i in heaviest[FIRST:]:
        whole = whole + at["weight"][i] * own.looked_up(terms[i], places)
    return places, np.round(whole, 9)


def _found(own: _Shard, terms: list[str], at: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's k best of those that may be among the k best of all."""
    floor, rest = at["_floor"][0], at["_rest"][0]
    score, seen = np.zeros(len(own.docs)), np.zeros(len(own.docs), bool)
    for i in np.flatnonzero(at["_brings"]):
        bound = at["_all"][i] - at["most"][i] + at["weight"][i] * own.top[rows := own.rows.get(terms[i], [])]
        for b in np.array(rows, int)[bound >= floor]:
            place, impact = own.block(b)
            score[place] += at["weight"][i] * impact
            seen[place] = True
    places = np.flatnonzero(seen & own.valid & (score + rest >= floor))
    score = score[places]
    for i in sorted(np.flatnonzero(~at["_brings"]), key=lambda i: (-at["most"][i], terms[i])):
        score = score + at["weight"][i] * own.looked_up(terms[i], places)
        rest -= at["most"][i]
        near = score + rest >= floor - 1e-9
        places, score = places[near], score[near]
        if not len(places):
            break
    return own.best(places, score, k)


def _each_shard(index: Blocks, asked: DataFrame, query: str, doc: str, k: int, look: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(query, doc, score): what `look` gives of each query in each shard. The queries' terms go to every task."""
    spark = asked.sparkSession
    whole = asked.orderBy(query).toArrow().combine_chunks()
    ids, terms = whole.column(query), whole.column("term").to_pylist()
    first = np.flatnonzero(np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy()))[: len(ids)]
    spans = list(zip(first, np.append(first, len(ids))[1:], strict=True))
    number = {c: whole.column(c).to_numpy() for c in whole.column_names if c not in (query, "term")}
    sent, mean = spark.sparkContext.broadcast((ids.take(pa.array(first)), spans, terms, number)), index.mean
    kinds = asked.schema[query].dataType, index.blocks.schema["doc"].dataType.elementType
    kind = pa.schema([(query, to_arrow_type(kinds[0])), (doc, to_arrow_type(kinds[1])), ("score", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        names, spans, terms, number = sent.value
        own, row, place, score = _Shard(rows, mean), [], [], []
        for q, (a, z) in enumerate(spans):
            p, s = look(own, terms[a:z], {c: x[a:z] for c, x in number.items()}, k)
            row.append(np.full(len(p), q)), place.append(p), score.append(s)
        at, docs = pa.array(np.concatenate([*row, np.zeros(0)]).astype("int64")), pa.array(np.concatenate([*place, np.zeros(0)]).astype("int64"))
        return pa.Table.from_arrays([names.take(at), own.docs.take(docs), pa.array(np.concatenate([*score, np.zeros(0)]))], schema=kind)

    wanted = asked.select("term").distinct().unionByName(spark.range(1).select(F.lit("").alias("term")))
    held = index.blocks.join(F.broadcast(wanted), "term", "left_semi")
    return held.groupBy("shard").applyInArrow(run, f"`{query}` {kinds[0].simpleString()}, `{doc}` {kinds[1].simpleString()}, score double")


def _plan(index: Blocks, queries: DataFrame, query: str, text: str, doc: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(asked: query, term, weight, most, _all, _floor: the score to reach, _brings: whether the term brings candidates,
    _rest: the most that terms without candidates may add; heads: the same with those of all blocks that the terms have)."""
    asked = written(queries.where(F.col(query).isNotNull()).select(query, F.explode(tokens(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qf")))
    terms = F.broadcast(asked.select("term").distinct())
    heads = written(index.heads.join(terms, "term", "left_semi"))
    known = asked.join(F.broadcast(index.terms.join(terms, "term", "left_semi")), "term").join(heads.groupBy("term").agg(F.max("top").alias("_top")), "term")
    asked = written(known.select(query, "term", (F.col("qf") * F.col("idf")).alias("weight"), (F.col("qf") * F.col("idf") * F.col("_top")).alias("most")))
    leaders = ranked(_each_shard(index, asked, query, doc, k, _first_look), query, "score", k, doc)
    reached = leaders.groupBy(query).agg(F.min("score").alias("_reached"), F.count(F.lit(1)).alias("_k"))
    # A negative weight would make parts of a score more than the whole: such queries read all.
    sums = asked.groupBy(query).agg(F.sum("most").alias("_all"), F.min("weight").alias("_least")).join(reached, query, "left")
    floor = F.when((F.col("_least") >= 0) & (F.col("_k") == k), F.col("_reached") - 1e-6).otherwise(F.lit(float("-inf")))
    lightest = Window.partitionBy(query).orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    known = asked.join(sums.select(query, "_all", floor.alias("_floor")), query).withColumn("_light", F.sum("most").over(lightest))
    light = F.col("_light") < F.col("_floor")
    rest = F.coalesce(F.max(F.when(light, F.col("_light"))).over(Window.partitionBy(query)), F.lit(0.0))
    asked = written(known.withColumns({"_brings": ~light, "_rest": rest}).drop("_light"))
    return asked, asked.join(heads, "term")


def topk(index: Blocks, queries: DataFrame, query: str, text: str, doc: str, k: int) -> DataFrame:
    """(query, doc, score, rank): as bm25_topk() gives them, from the blocks that can matter.

    A document that is among the k best has a posting in a block that is read, as without one it reaches less than k others
    have for certain, and none in a skipped block of a term that brings candidates. So what it has from the blocks read and the
    most that the other terms may add bound its score from above. Equal scores, which rounding to 9 places makes, are not skipped.
    """

    def one(some: DataFrame) -> DataFrame:
        asked, _ = _plan(index, some, query, text, doc, k)
        return ranked(_each_shard(index, asked, query, doc, k, _found), query, "score", k, doc)

    return _all([one(some) for some in some_at_once(queries, query, ASKED)])


def read_share(index: Blocks, queries: DataFrame, query: str, text: str, doc: str, k: int) -> DataFrame:
    """(query, postings, read): the postings that a query's terms have, and those in blocks that bring candidates."""

    def one(some: DataFrame) -> DataFrame:
        _, heads = _plan(index, some, query, text, doc, k)
        bound = F.col("_all") - F.col("most") + F.col("weight") * F.col("top")
        read = F.when(F.col("_brings") & (bound >= F.col("_floor")), F.col("n")).otherwise(0)
        return heads.groupBy(query).agg(F.sum("n").alias("postings"), F.sum(read).alias("read"))

    return _all([one(some) for some in some_at_once(queries, query, ASKED)])
