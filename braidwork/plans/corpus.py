"""Queries on text, search and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer as A
from ..operators import cohort as C
from ..operators import fill as L
from ..operators import evaluate as V
from ..operators import markdown as M
from ..operators import retrieval as R
from ..operators import transcripts as S
from .common import r6, shared, table

RULES = S.Rules(terms=("the", "und", "les"), phrases=("of the", "in the"), fillers=("and", "the", "of"), verbs=("is", "in"))


#: Words and overlaps of the sweep's chunks.
SIZES = ((60, 0), (60, 15), (150, 45))


def text_tokens_df(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int"), "role", "text")


def sentence_extract(spark: SparkSession, d: str) -> DataFrame:
    found = _turns(spark, d).select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("n", "raw"))
    return found.select("conv_id", "turn", "n", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("sentence"))


def _rejoined(spark: SparkSession, d: str) -> DataFrame:
    return S.rejoin(_turns(spark, d).withColumn("ts", F.col("turn") * 7), ["conv_id"], "turn")


def sentence_rejoin_ts(spark: SparkSession, d: str) -> DataFrame:
    return _rejoined(spark, d)


def classify_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _rejoined(spark, d).withColumn("text", F.col("sentence")).withColumn("duration", F.lit(0))
    return S.classify(rows, ["conv_id"], rules=RULES).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def removal_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _rejoined(spark, d).withColumn("text", F.col("sentence")).withColumn("duration", F.lit(0))
    out = S.removal_report(S.classify(rows, ["conv_id"], rules=RULES))
    return out.select("reason", "n", "total", "kept", r6("kept_pct").alias("kept_pct"))


def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(_rejoined(spark, d), ["conv_id"], "n", words=60, overlap=15)


def sweep_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of keyword search over the conversations' chunks, by size and overlap; a talk's title is its number's last digit."""
    said = _rejoined(spark, d).withColumn("title", F.concat(F.lit("talk "), (F.col("conv_id") % 10).cast("string")))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("q"), F.array(F.concat(F.lit("Talk "), (F.col("item_id") % 10).cast("string"))).alias("expect_sources"))
    sizes = spark.createDataFrame(list(SIZES), "size int, overlap int")
    told = V.chunk_sweep(said, asked, sizes, ["conv_id"], "n")
    return told.select("size", "overlap", *(r6(c).alias(c) for c in ("recall_1", "recall_3", "recall_k", "mrr")), "n")


def chunk_lint(spark: SparkSession, d: str) -> DataFrame:
    """The lint's counts, documents standing for chunks of their source; some are given a mark, a rule or front matter."""
    n, text = F.coalesce("n_chars", F.lit(0)), F.col("text")
    spoilt = F.when(n % 3 == 0, F.concat(F.lit("## Part\n\n: "), text)).when(n % 5 == 0, F.concat(F.lit("---\ntags: x\n"), text)).otherwise(text)
    return M.lint(table(spark, d, "documents").select(spoilt.alias("text"), F.col("source").alias("source_title"), F.col("lang").alias("parent_id"), F.col("n_chars").alias("token_count")))


def looked_up_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the best label told of it, where there is one; labels come twice, the second time the worst."""
    labels = table(spark, d, "labels").select("doc_id", "toxic", "quality")
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(1).cast(labels.schema["toxic"].dataType)))
    return L.looked_up(table(spark, d, "documents").select("doc_id", "lang"), twice, ["doc_id"], ["toxic", "quality"])


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), F.substring(x, 1, 30), F.lit("\n\n"), x)).otherwise(x)), "\n\n")
    return M.chunk_notes(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), body.alias("text")))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q"))


def _index(spark: SparkSession, d: str):
    return R.build_index(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", shared(spark))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_topk(_index(spark, d), _queries(spark, d), "q_id", "q", "doc_id", 5).select("q_id", "doc_id", r6("score").alias("score"), "rank")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), F.col("label").alias("q_label"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(_vectors(spark, d), _asked(spark, d), "q_id", "q_vec", "vec_id", "embedding", 5).select("q_id", "vec_id", r6("score").alias("score"), "rank")


def vector_topk_blas(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk_blas(_vectors(spark, d), _asked(spark, d), "q_id", "q_vec", "vec_id", "embedding", 5).select("q_id", "vec_id", r6("score").alias("score"), "rank")


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).join(_vectors(spark, d).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec")), "q_id", "left")


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector search fused: documents and embeddings paired by number."""
    out = R.hybrid(_vectors(spark, d).withColumnRenamed("vec_id", "doc_id"), _paired(spark, d), _index(spark, d), "q_id", "q", "q_vec", "doc_id", "embedding", 5)
    return out.select("q_id", "doc_id", r6("score").alias("score"), "rank")


def vector_only(spark: SparkSession, d: str) -> DataFrame:
    """The search by vectors alone, keywords switched off."""
    out = R.hybrid(_vectors(spark, d).withColumnRenamed("vec_id", "doc_id"), _paired(spark, d), None, "q_id", "q", "q_vec", "doc_id", "embedding", 5, use_keywords=False)
    return out.select("q_id", "doc_id", r6("score").alias("score"), "rank")


def _like(asked: list[str], found: list[str]) -> list[float]:
    """A stand-in for a model, of which SQL can say the same."""
    return [float(len(q) * 7 % 13 + len(t) % 11) for q, t in zip(asked, found, strict=True)]


def reranked(spark: SparkSession, d: str) -> DataFrame:
    hits = R.bm25_topk(_index(spark, d), _queries(spark, d), "q_id", "q", "doc_id", R.pool_size(5))
    rows = hits.join(_queries(spark, d), "q_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return R.rerank(rows, "q_id", "doc_id", "q", "text", 5, _like).select("q_id", "doc_id", "rerank_score", "rank")


def best_scores(spark: SparkSession, d: str) -> DataFrame:
    hits = R.bm25_topk(_index(spark, d), _queries(spark, d), "q_id", "q", "doc_id", 5).where("score >= 20")
    return R.best_score(hits, _queries(spark, d), "q_id").select("q_id", r6("score").alias("score"))


def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    hits = R.vector_topk(_vectors(spark, d), _asked(spark, d), "q_id", "q_vec", "vec_id", "embedding", 20)
    chunks = _vectors(spark, d).select("vec_id", F.concat(F.lit("p"), (F.col("vec_id") % 7).cast("string")).alias("parent_id"), F.concat(F.lit("parent "), (F.col("vec_id") % 7).cast("string")).alias("parent_text"), F.col("vec_id").cast("string").alias("text"))
    return R.expand_parents(hits, chunks, "q_id", "vec_id", 3).select("q_id", "vec_id", "parent_id", "text", "child_text", "rank")


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    hits = R.vector_topk(_vectors(spark, d), _asked(spark, d), "q_id", "q_vec", "vec_id", "embedding", 5, exclude_self=True)
    hits = hits.join(_vectors(spark, d).select("vec_id", "label"), "vec_id")
    return V.hit_ranks(_asked(spark, d).select("q_id", "q_label"), hits, "q_id", F.col("label") == F.col("q_label"), "q_label")


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    out = V.recall(_ranks(spark, d), 5)
    return out.select(*(r6(c).alias(c) for c in out.columns[:-1]), "n")


def recall_by_label(spark: SparkSession, d: str) -> DataFrame:
    out = V.recall(_ranks(spark, d), 5, "q_label")
    return out.select("q_label", *(r6(c).alias(c) for c in out.columns[1:-1]), "n")


def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    ranks = _ranks(spark, d)
    out = V.metric_delta(V.recall(ranks, 5), V.recall(ranks.withColumn("rank", F.when(F.col("rank") <= 2, F.col("rank"))), 5))
    return out.select(*(r6(c).alias(c) for c in out.columns))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.length("text") % 997 / 997).alias("score"))
    return table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("inside")).join(docs, "doc_id")


def coverage_separation(spark: SparkSession, d: str) -> DataFrame:
    out = V.separation(_scores(spark, d))
    return out.select(*(r6(c).alias(c) for c in out.columns))


def overlap_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.overlap_rows(_scores(spark, d)).select("doc_id", "inside", r6("score").alias("score"))


def boundary_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.boundary_rows(_scores(spark, d), key="doc_id").select("doc_id", "inside", r6("score").alias("score"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return V.threshold_sweep(_scores(spark, d)).withColumn("accuracy", r6("accuracy"))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return V.best_threshold(V.threshold_sweep(_scores(spark, d))).withColumn("accuracy", r6("accuracy"))


def grid_rank(spark: SparkSession, d: str) -> DataFrame:
    g = V.grid([100, 150, 220, 300], [0, 45, 100, 150], spark).withColumn("recall_k", F.col("size") % 7 / 10 + F.col("overlap") / 1000).withColumn("mrr", F.col("overlap") / 200)
    out = V.grid_rank(g, "recall_k", "mrr", "size", "overlap")
    return out.select("size", "overlap", r6("recall_k").alias("recall_k"), "place", r6("spread").alias("spread"), "is_noise")


def history_blend(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).withColumnsRenamed({"conv_id": "session", "text": "content"})
    asked = turns.select("session").distinct().withColumn("question", F.lit("and then?"))
    return A.blended(asked, turns).select("session", "query")


def history_lines(spark: SparkSession, d: str) -> DataFrame:
    return A.last_turns(_turns(spark, d).withColumnsRenamed({"conv_id": "session", "text": "content"}), n=4)


def answer_policy(spark: SparkSession, d: str) -> DataFrame:
    pol = A.Policy(report=r"(?i)\bthe report\b", off_topic=r"(?i)\bthe\b.{0,40}\bis\b", banned=(r"\bwhich\b", r"\bhaha\b"), inline_drill=r"(?i)\bof\s+and\b")
    rows = _turns(spark, d)
    return rows.select("conv_id", "turn", F.coalesce(A.verdict(F.col("text"), F.col("text"), pol), F.lit("ok")).alias("reason"))


def stripped_markup(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit(" [a | b @ 0:00] x  \n y (general coaching)"), F.when(F.col("turn") % 2 == 0, "\n\nSources:\n- one\n- two").otherwise(""))
    return _turns(spark, d).select("conv_id", "turn", A.stripped(text).alias("answer"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), F.col("lang"), "doc_id", 10)


def union_distinct_resume(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return docs.unionByName(labels).distinct().join(labels.distinct(), "doc_id", "left_anti")


def set_tests(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokens(F.col("text"), "[a-z']+")
    return table(spark, d, "documents").select("doc_id", T.overlaps_set(words, ("moron", "scum")).alias("some"), T.all_in_set(words, ("the", "of")).alias("every"), T.word_count(F.col("text")).cast("long").alias("n_words"))


def clocks(spark: SparkSession, d: str) -> DataFrame:
    clock = T.clock_of(F.col("doc_id") * 37)
    return table(spark, d, "documents").select("doc_id", clock.alias("clock"), T.seconds_of(clock).cast("long").alias("seconds"))


def preview_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.cell(F.col("text")).alias("cell"), T.lead_repaired(F.expr("substring(text, 3)")).alias("led"))


def edge_zone(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).withColumn("ts", F.col("turn") * 60)
    place = F.col("ts") / F.greatest(F.max("ts").over(Window.partitionBy("conv_id")), F.lit(1))
    return turns.select("conv_id", "turn", r6(place).alias("place"), ((place <= 0.12) | (place >= 0.88) | (F.col("ts") <= 25)).alias("edge"))


QUERIES = {f.__name__: f for f in (sweep_recall, chunk_lint, looked_up_rows, 
    text_tokens_df, sentence_extract, sentence_rejoin_ts, classify_reasons, removal_report, chunk_words, markdown_chunks, bm25_topk, vector_topk, vector_topk_blas, hybrid_rrf, vector_only, reranked, best_scores, parent_expand, recall_mrr, recall_by_label, metric_delta,
    coverage_separation, overlap_rows, boundary_rows, threshold_sweep, best_threshold, grid_rank, history_blend, history_lines, answer_policy, stripped_markup, stratified_sample, union_distinct_resume, set_tests, clocks, preview_lines, edge_zone,
)}

_TOK = "regexp_extract_all(lower({}), '[a-z0-9'']+')"
_BM = f"""post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format("text")}) AS term FROM documents) GROUP BY 1, 2),
  len AS (SELECT doc_id, len({_TOK.format("text")}) AS dl FROM documents), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
  raw AS (SELECT term, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, n GROUP BY term, n.n),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  asked AS (SELECT item_id AS q_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
  bm AS (SELECT q_id, post.doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM asked JOIN idf USING (term) JOIN post USING (term) JOIN len ON len.doc_id = post.doc_id, n GROUP BY 1, 2),
  bmr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
_DOT = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_VEC = f"SELECT q.vec_id AS q_id, v.vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0"
_RANKS = f"SELECT a.vec_id AS q_id, a.label AS q_label, min(CASE WHEN e.label = a.label THEN h.rank END) AS rank FROM embeddings a LEFT JOIN (SELECT * FROM ({_VEC} AND q.vec_id <> v.vec_id) WHERE rank <= 5) h ON h.q_id = a.vec_id LEFT JOIN embeddings e ON e.vec_id = h.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2"
_MEAS = "round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_k, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6) AS mrr, count(*) AS n"
_SC = "(SELECT doc_id, quality = 1 AS inside, length(text) % 997 / 997.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
_SEP = f"SELECT min(score) FILTER (inside) AS ic_min, avg(score) FILTER (inside) AS ic_mean, max(score) FILTER (NOT inside) AS ooc_max, avg(score) FILTER (NOT inside) AS ooc_mean FROM {_SC}"
_SWEEP = f"""SELECT threshold, count(*) FILTER (inside AND score >= threshold) AS ic_answered, count(*) FILTER (inside) AS ic_total, count(*) FILTER (NOT inside AND score < threshold) AS ooc_abstained, count(*) FILTER (NOT inside) AS ooc_total,
  round((count(*) FILTER (inside AND score >= threshold) + count(*) FILTER (NOT inside AND score < threshold)) / count(*), 6) AS accuracy
  FROM {_SC}, (SELECT round(lo + (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * i / 24, 3) AS threshold FROM (SELECT min(score) AS lo, max(score) AS hi FROM {_SC}), (SELECT unnest(range(0, 25)) AS i)) GROUP BY threshold"""
_SENT = r"[^.!?]+[.!?]+|\S[^.!?]*$"
_JOINED = f"""whole AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS j FROM conversations GROUP BY 1),
  seg AS (SELECT conv_id, turn * 7 AS ts, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM conversations),
  raw AS (SELECT conv_id, length(j) AS full_, length(regexp_extract(j, '^[.!?]*')) AS skip, p AS pieces FROM (SELECT conv_id, j, regexp_extract_all(j, '{_SENT}') AS p FROM whole)),
  pc AS (SELECT conv_id, full_, skip, i - 1 AS n, pieces[i] AS raw FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM raw)),
  st AS (SELECT conv_id, n, raw, CASE WHEN regexp_matches(raw, '[.!?]\\z') THEN skip + coalesce(sum(length(raw)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE full_ - length(raw) END AS begun FROM pc),
  sent AS (SELECT conv_id, CAST(n AS INTEGER) AS n, CAST((SELECT max_by(ts, pos) FROM seg WHERE seg.conv_id = st.conv_id AND pos <= st.begun) AS INTEGER) AS ts, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS sentence FROM st WHERE regexp_replace(raw, '\\s+', '', 'g') <> '')"""


def _sql(patterns) -> str:
    return "regexp_matches(s, '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


_W = "regexp_extract_all(lower(s), '[a-z'']+')"
_TOPIC = f"(regexp_matches(lower(s), 'of the|in the') OR list_has_any({_W}, ['the', 'und', 'les']))"
_VERB = f"list_has_any({_W}, ['is', 'in'])"
_EDGE = "(place <= 0.12 OR place >= 0.88 OR ts <= 25)"
_REASON = f"""CASE WHEN length(s) < 3 THEN 'empty/too short' WHEN {_sql(S.MUSIC)} THEN 'music/sound marker' WHEN NOT {_TOPIC} AND {_EDGE} AND {_sql(S.LYRICS)} THEN 'music/lyrics'
  {" ".join(f"WHEN NOT {_TOPIC} AND {_sql(p)} THEN '{n}'" for n, p in RULES.framing)}
  WHEN NOT {_TOPIC} AND len({_W}) BETWEEN 1 AND 4 AND NOT {_VERB} AND list_has_all(['and', 'the', 'of'], {_W}) THEN 'filler' WHEN NOT {_TOPIC} AND len({_W}) <= 2 AND NOT {_VERB} THEN 'name/fragment' END"""
_CLASS = f"cls AS (SELECT *, {_REASON} AS reason FROM (SELECT *, sentence AS s, ts / CAST(greatest(max(ts) OVER (PARTITION BY conv_id), 1) AS DOUBLE) AS place FROM sent))"

def _chunks_sql(words: int, overlap: int) -> str:
    return f"""WITH RECURSIVE {_JOINED}, s AS (SELECT conv_id, ts, sentence, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k, len(regexp_extract_all(sentence, '\\S+')) AS w FROM sent),
      c AS (SELECT *, sum(w) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM s), l AS (SELECT conv_id, list(upto ORDER BY k) AS t FROM c GROUP BY conv_id),
      r(conv_id, idx, b, new, e) AS (SELECT conv_id, 0, 0, 0, greatest(1, len(list_filter(t, lambda x: x <= {words}))) FROM l UNION ALL
        SELECT conv_id, idx + 1, b, e, greatest(e + 1, len(list_filter(t, lambda x: x <= start + {words})))
        FROM (SELECT *, CASE WHEN b = 0 THEN 0 ELSE t[b] END AS start FROM (SELECT r.conv_id, r.idx, r.e, l.t, greatest(r.b, len(list_filter(l.t, lambda x: x <= l.t[r.e] - {overlap}))) AS b FROM r JOIN l ON l.conv_id = r.conv_id WHERE r.e < len(l.t))))
      SELECT r.conv_id, CAST(r.idx AS INTEGER) AS chunk_index, CAST(any_value(c.ts) FILTER (c.k = r.new + 1) AS INTEGER) AS timestamp_s, string_agg(c.sentence, ' ' ORDER BY c.k) AS text, CAST(sum(c.w) AS INTEGER) AS word_count
      FROM r JOIN c ON c.conv_id = r.conv_id AND c.k > r.b AND c.k <= r.e GROUP BY r.conv_id, r.idx, r.new"""


def _sweep_sql(words: int, overlap: int) -> str:
    """One combination's measures, from its own chunks and index."""
    return f"""SELECT {words} AS size, {overlap} AS overlap, {_MEAS} FROM (WITH docs AS MATERIALIZED (SELECT 'talk ' || conv_id % 10 AS title, conv_id || '::' || chunk_index AS id, {_TOK.format("text")} AS t FROM ({_chunks_sql(words, overlap)})),
      post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM docs) GROUP BY 1, 2), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
      raw AS (SELECT term, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, n GROUP BY term, n.n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
      asked AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TOK.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
      bm AS (SELECT item_id, docs.id, title, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 9) AS score FROM asked JOIN idf USING (term) JOIN post USING (term) JOIN docs ON docs.id = post.id, n GROUP BY 1, 2, 3),
      best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM bm)
      SELECT b.item_id, min(rank) FILTER (rank <= 5 AND title = 'talk ' || b.item_id % 10) AS rank FROM benchmark b LEFT JOIN best USING (item_id) GROUP BY 1)"""


ORACLE = {
    "text_tokens_df": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1",
    "sentence_extract": f"SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(i - 1 AS INTEGER) AS n, regexp_replace(p[i], '^\\s+|\\s+$', '', 'g') AS sentence FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '{_SENT}') AS p FROM conversations))",
    "chunk_words": _chunks_sql(60, 15),
    "sweep_recall": " UNION ALL ".join(_sweep_sql(*s) for s in SIZES),
    "chunk_lint": r"""WITH c AS (SELECT source, lang, n_chars, CASE WHEN coalesce(n_chars, 0) % 3 = 0 THEN '## Part' || chr(10) || chr(10) || ': ' || text WHEN coalesce(n_chars, 0) % 5 = 0 THEN '---' || chr(10) || 'tags: x' || chr(10) || text ELSE text END AS t FROM documents),
      k AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM c WHERE n_chars IS NOT NULL)
      SELECT source AS source_title, count(*) AS n, count(DISTINCT lang) AS parents, (SELECT n_chars FROM k WHERE k.source IS NOT DISTINCT FROM c.source AND i = n // 2) AS tokens, count(*) FILTER (regexp_matches(regexp_replace(t, '^(?:#{1,6}\s+[^\n]*\n|\s*\n)*', ''), '^[\s.:,;!?)\]]')) AS lead,
      count(*) FILTER (regexp_matches(t, '(?m)^(?:-{3,}|\*{3,}|_{3,})$')) AS rules, count(*) FILTER (regexp_matches(t, '^---\n[\w-]+\s*:')) AS leaks FROM c GROUP BY source""",
    "looked_up_rows": "SELECT d.doc_id, lang, toxic, quality, toxic IS NOT NULL OR quality IS NOT NULL AS found FROM documents d LEFT JOIN (SELECT doc_id, min(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)",
    "sentence_rejoin_ts": f"WITH {_JOINED} SELECT conv_id, n, ts, sentence FROM sent",
    "classify_reasons": f"WITH {_JOINED}, {_CLASS} SELECT reason, count(*) AS n FROM cls GROUP BY 1",
    "removal_report": f"WITH {_JOINED}, {_CLASS} SELECT reason, count(*) AS n, (SELECT count(*) FROM cls) AS total, (SELECT count(*) FROM cls WHERE reason IS NULL) AS kept, round(100.0::DOUBLE * (SELECT count(*) FROM cls WHERE reason IS NULL) / (SELECT count(*) FROM cls), 6) AS kept_pct FROM cls WHERE reason IS NOT NULL GROUP BY 1",
    "bm25_topk": f"WITH {_BM} SELECT q_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bmr WHERE rank <= 5",
    "vector_topk": f"SELECT q_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_VEC}) WHERE rank <= 5",
    "vector_topk_blas": f"SELECT q_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_VEC}) WHERE rank <= 5",
    "vector_only": f"SELECT * FROM (SELECT q.vec_id AS q_id, v.vec_id AS doc_id, round({_DOT}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) AS INTEGER) AS rank FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v) WHERE rank <= 5",
    "reranked": f"""WITH {_BM}, s AS (SELECT q_id, doc_id, bmr.rank AS was, CAST(length(b.text) * 7 % 13 + length(d.text) % 11 AS DOUBLE) AS rerank_score FROM bmr JOIN benchmark b ON b.item_id = q_id JOIN documents d USING (doc_id) WHERE bmr.rank <= 20)
      SELECT * FROM (SELECT q_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY rerank_score DESC, was, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "best_scores": f"WITH {_BM} SELECT b.item_id AS q_id, round(coalesce(x.score, 0), 6) AS score FROM benchmark b LEFT JOIN bmr x ON x.q_id = b.item_id AND x.rank = 1 AND x.score >= 20",
    "hybrid_rrf": f"""WITH {_BM}, vec AS (SELECT b.item_id AS q_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY {_DOT} DESC, v.vec_id) AS rank FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v),
      kw AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM bmr WHERE rank <= 20 AND score >= 2.0 AND q_id IN (SELECT vec_id FROM embeddings)),
      u AS (SELECT q_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part, 0 AS nr, rank FROM vec WHERE rank <= 20 UNION ALL SELECT q_id, doc_id, 0.35::DOUBLE / (60 + rank), 1, rank FROM kw),
      f AS (SELECT q_id, doc_id, sum(part) AS score, min(nr * 1000 + rank) AS first FROM u GROUP BY 1, 2)
      SELECT q_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, first, doc_id) AS rank FROM f) WHERE rank <= 5""",
    "parent_expand": f"""SELECT q_id, vec_id, 'p' || vec_id % 7 AS parent_id, 'parent ' || vec_id % 7 AS text, CAST(vec_id AS VARCHAR) AS child_text, CAST(place AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id, vec_id % 7 ORDER BY rank) AS f FROM ({_VEC}) WHERE rank <= 20) WHERE f = 1) WHERE place <= 3""",
    "recall_mrr": f"SELECT {_MEAS} FROM ({_RANKS})",
    "recall_by_label": f"SELECT q_label, {_MEAS} FROM ({_RANKS}) GROUP BY 1",
    "metric_delta": f"SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS d_recall_1, round(avg(CASE WHEN rank = 3 THEN 1.0 ELSE 0.0 END), 6) AS d_recall_3, round(avg(CASE WHEN rank BETWEEN 3 AND 5 THEN 1.0 ELSE 0.0 END), 6) AS d_recall_k, round(avg(CASE WHEN rank > 2 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS d_mrr FROM ({_RANKS})",
    "coverage_separation": f"SELECT round(ic_min, 6) AS ic_min, round(ic_mean, 6) AS ic_mean, round(ooc_max, 6) AS ooc_max, round(ooc_mean, 6) AS ooc_mean, round(ic_min - ooc_max, 6) AS gap, CASE WHEN ic_min > ooc_max THEN round((ic_min + ooc_max) / 2, 3) END AS suggested_threshold FROM ({_SEP})",
    "overlap_rows": f"SELECT doc_id, inside, round(score, 6) AS score FROM {_SC}, ({_SEP}) WHERE (inside AND score < ooc_max) OR (NOT inside AND score > ic_min)",
    "boundary_rows": f"SELECT * FROM (SELECT doc_id, inside, round(score, 6) AS score FROM {_SC} s1 WHERE inside ORDER BY s1.score, doc_id LIMIT 5) UNION ALL SELECT * FROM (SELECT doc_id, inside, round(score, 6) AS score FROM {_SC} s2 WHERE NOT inside ORDER BY s2.score DESC, doc_id LIMIT 5)",
    "threshold_sweep": _SWEEP,
    "best_threshold": f"SELECT * FROM ({_SWEEP}) ORDER BY accuracy DESC, threshold LIMIT 1",
    "grid_rank": """WITH g AS (SELECT size, overlap, size % 7 / 10.0::DOUBLE + overlap / 1000.0::DOUBLE AS recall_k, overlap / 200.0::DOUBLE AS mrr FROM (SELECT unnest([100, 150, 220, 300]) AS size), (SELECT unnest([0, 45, 100, 150]) AS overlap) WHERE overlap < size)
      SELECT size, overlap, round(recall_k, 6) AS recall_k, CAST(row_number() OVER (ORDER BY recall_k DESC, mrr DESC, size, overlap) AS INTEGER) AS place, round(max(recall_k) OVER () - min(recall_k) OVER (), 6) AS spread, max(recall_k) OVER () - min(recall_k) OVER () < 0.06 AS is_noise FROM g""",
    "history_blend": "SELECT conv_id AS session, trim(concat_ws(' ', max_by(trim(text), turn) FILTER (role = 'user' AND trim(text) <> ''), 'and then?')) AS query FROM conversations GROUP BY 1",
    "history_lines": "SELECT conv_id AS session, string_agg(CASE WHEN role = 'user' THEN 'Athlete: ' ELSE 'Coach: ' END || trim(text), chr(10) || chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4 AND trim(text) <> '' GROUP BY 1",
    "answer_policy": r"""SELECT conv_id, CAST(turn AS INTEGER) AS turn, CASE WHEN length(trim(text)) < 20 THEN 'answer too short' WHEN regexp_matches(text, '\s*\[[^\[\]]*(?:@|\|)[^\[\]]*\]') OR regexp_matches(chr(10) || text, '(?is)\n+\s*(?:Sources|Retrieved from)\s*:\s*\n.*\z') THEN 'answer still contains source citations; write prose only'
      WHEN regexp_matches(text, '(?i)\bwhich\b') THEN 'banned claim: ''' || regexp_extract(text, '(?i)\bwhich\b') || '''' WHEN regexp_matches(text, '(?i)\bhaha\b') THEN 'banned claim: ''' || regexp_extract(text, '(?i)\bhaha\b') || ''''
      WHEN (regexp_matches(text, '(?i)\bthe report\b') OR regexp_matches(text, '(?i)\bthe\b.{0,40}\bis\b')) AND (regexp_matches(text, '(?im)^(?:#{1,3}\s+)?[\w][\w ''’.-]*\bdrill\b') OR regexp_matches(text, '(?i)\bof\s+and\b')) THEN 'do not include a drill on a refusal, off-topic, or report question' ELSE 'ok' END AS reason FROM conversations""",
    "stripped_markup": "SELECT conv_id, CAST(turn AS INTEGER) AS turn, regexp_replace(text || ' x' || chr(10) || ' y', '^\\s+|\\s+$', '', 'g') AS answer FROM conversations",
    "stratified_sample": "SELECT doc_id, lang, lang AS stratum FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 10",
    "union_distinct_resume": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "set_tests": "SELECT doc_id, list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), ['moron', 'scum']) AS some, list_has_all(['the', 'of'], regexp_extract_all(lower(text), '[a-z'']+')) AS every, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM documents",
    "clocks": "SELECT doc_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock, s AS seconds FROM (SELECT doc_id, doc_id * 37 AS s FROM documents)",
    "preview_lines": r"SELECT doc_id, CASE WHEN length(f) > 110 THEN substr(f, 1, 107) || '...' ELSE f END AS cell, trim(regexp_replace(substr(text, 3), '^[\s.:,;!?)\]]+', '')) AS led FROM (SELECT doc_id, text, replace(text, '|', '\|') AS f FROM documents)",
    "edge_zone": "SELECT conv_id, CAST(turn AS INTEGER) AS turn, round(p, 6) AS place, p <= 0.12 OR p >= 0.88 OR turn * 60 <= 25 AS edge FROM (SELECT conv_id, turn, turn * 60 / CAST(greatest(max(turn * 60) OVER (PARTITION BY conv_id), 1) AS DOUBLE) AS p FROM conversations)",
}
