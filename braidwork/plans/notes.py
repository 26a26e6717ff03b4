"""Queries of Markdown notes made from the documents: front matter, blocks, sections, joined pieces, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markdown as M
from .common import table

FRONT = "---\ntitle: A talk\ntags:\n- Drill work\n- hips\nother: 1\n---\n"


def _line(x: Column, i: Column) -> Column:
    """Every line of a text becomes what its number asks for: headings of three levels, lists, tables, quotes, rules."""
    part = lambda a, n: F.substring(x, a, n)
    return (
        F.when(i % 7 == 0, F.concat(F.lit("# "), part(1, 20), F.lit("\n\n"), x))
        .when(i % 7 == 2, F.concat(F.lit("## What is "), part(1, 12), F.lit("\n"), x))
        .when(i % 7 == 3, F.concat(F.lit("### "), part(3, 12), F.lit("\n\n- "), x, F.lit("\n\n- b\n  more\n\nDo:\n\n1. "), part(1, 50)))
        .when(i % 7 == 4, F.concat(F.lit("### Part "), (i % 3).cast("string"), F.lit(" [abcdefgh12]\n\nshort one.")))
        .when(i % 7 == 5, F.concat(F.lit("| a | b |\n|---|---|\n| 1 |"), part(1, 40), F.lit("|\n***\n> "), x))
        .otherwise(x)
    )


def _notes(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform(F.split("text", "\n"), _line), "\n\n")
    front = F.when(F.col("doc_id") % 3 == 0, FRONT).otherwise("")
    return table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.concat(front, text).alias("text"))


def note_facts(spark: SparkSession, d: str) -> DataFrame:
    """What names and front matter tell, and the length of what is left."""
    return M.noted(_notes(spark, d)).select("of.name", "of.title", F.array_join("of.tags", ",").alias("tags"), F.length("body").cast("long").alias("n_chars"))


def note_blocks(spark: SparkSession, d: str) -> DataFrame:
    return M.blocks(M.noted(_notes(spark, d))).select("of.name", F.col("block").cast("long").alias("block"), "kind", "text")


def note_sections(spark: SparkSession, d: str) -> DataFrame:
    path = F.array_join(F.transform("path", lambda p: p["title"]), " > ")
    made = M.sections(M.blocks(M.noted(_notes(spark, d))))
    return made.select("of.name", F.col("section").cast("long").alias("section"), path.alias("path"), F.size("blocks").cast("long").alias("n_blocks"), "body", M.content_type(F.col("path"), F.col("of.tags")).alias("content_type"))


def note_pieces(spark: SparkSession, d: str) -> DataFrame:
    made = M.sections(M.blocks(M.noted(_notes(spark, d)))).withColumn("name", F.col("of.name"))
    return M.glued(made, ["_key", "name", "section"]).select("name", F.col("section").cast("long").alias("section"), F.col("n").cast("long").alias("n"), "kind", "text")


def note_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the documents, without spaces and marks at their beginning."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    own = docs.select("doc_id", F.posexplode(M.sentences(F.col("text"))).alias("n", "sentence"))
    return own.select("doc_id", F.col("n").cast("long").alias("n"), M.led(F.col("sentence")).alias("sentence"))


QUERIES = {f.__name__: f for f in (note_facts, note_blocks, note_sections, note_pieces, note_sentences)}

_MADE = r"""notes AS (
  SELECT doc_id || '.md' AS name, CASE WHEN doc_id % 3 = 0 THEN E'---\ntitle: A talk\ntags:\n- Drill work\n- hips\nother: 1\n---\n' ELSE '' END || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 7
      WHEN 0 THEN '# ' || x[1:20] || E'\n\n' || x
      WHEN 2 THEN '## What is ' || x[1:12] || E'\n' || x
      WHEN 3 THEN '### ' || x[3:14] || E'\n\n- ' || x || E'\n\n- b\n  more\n\nDo:\n\n1. ' || x[1:50]
      WHEN 4 THEN '### Part ' || ((i - 1) % 3) || E' [abcdefgh12]\n\nshort one.'
      WHEN 5 THEN E'| a | b |\n|---|---|\n| 1 |' || x[1:40] || E'|\n***\n> ' || x
      ELSE x END), E'\n\n') AS raw
  FROM documents WHERE text IS NOT NULL),
bodies AS (SELECT name, raw, regexp_replace(raw, '(?s)^\s*---\n[\w-]+\s*:.*\n---\s*\n?', '') AS body FROM notes)"""

_BLOCKS = r""",
split AS (SELECT name, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM bodies),
lines AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*$') THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 'heading' WHEN regexp_matches(line, '^\s*\|') THEN 'table'
    WHEN regexp_matches(line, '^\s*>') THEN 'quote' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+') THEN 'list' ELSE 'para' END AS own
  FROM split WHERE NOT regexp_matches(line, '^\s*(-{3,}|\*{3,}|_{3,})\s*$')),
-- A line belongs to the list that is open: the last line that doesn't merely continue was an item.
states AS (SELECT *, CASE WHEN own = 'blank' AND coalesce(lead(own) OVER w, '') = 'list' THEN NULL WHEN own NOT IN ('blank', 'list') AND regexp_matches(line, '^[ \t]') THEN NULL ELSE own = 'list' END AS state
  FROM lines WINDOW w AS (PARTITION BY name ORDER BY n)),
kinds AS (SELECT name, n, line, CASE WHEN coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY name ORDER BY n ROWS UNBOUNDED PRECEDING), false) THEN 'list' ELSE own END AS kind FROM states),
marks AS (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY name ORDER BY n) THEN 1 ELSE 0 END AS new FROM kinds),
runs AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM marks),
blocks AS (SELECT name, block::BIGINT AS block, any_value(kind) AS kind,
    CASE WHEN any_value(kind) = 'list' THEN regexp_replace(string_agg(line, chr(10) ORDER BY n), '\s+$', '') ELSE regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+', ''), '\s+$', '') END AS text
  FROM runs WHERE kind <> 'blank' GROUP BY name, block)"""


def _sections_sql() -> str:
    levels = range(1, 7)
    at = ", ".join(f"max(block) FILTER (WHERE level = {k}) OVER w AS at{k}, arg_max(title, block) FILTER (WHERE level = {k}) OVER w AS t{k}" for k in levels)
    alive = [f"at{k} IS NOT NULL" + "".join(f" AND at{k} > coalesce(at{j}, 0)" for j in range(1, k)) + (" AND NOT regexp_matches(t1, '\\[[A-Za-z0-9_-]{8,}\\]')" if k == 1 else "") for k in levels]
    path = "list_filter([" + ", ".join(f"CASE WHEN {a} THEN t{k} END" for k, a in zip(levels, alive, strict=True)) + "], lambda x: x IS NOT NULL)"
    return rf""",
heads AS (SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract(text, '^(#+)', 1)) END AS level, CASE WHEN kind = 'heading' THEN trim(regexp_extract(text, '^#+\s+(.*)$', 1)) END AS title FROM blocks),
stacks AS (SELECT *, {at}, count(*) FILTER (WHERE kind = 'heading') OVER w AS section FROM heads WINDOW w AS (PARTITION BY name ORDER BY block ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT name, section, block, kind, text, {path} AS path FROM stacks WHERE kind <> 'heading'),
sections AS (SELECT name, section, any_value(path) AS path, count(*) AS n_blocks, string_agg(text, E'\n\n' ORDER BY block) FILTER (WHERE regexp_matches(text, '\S')) AS body FROM placed GROUP BY name, section HAVING body <> '')"""


_PIECES = r""",
own AS (SELECT p.* FROM placed p SEMI JOIN sections USING (name, section)
  WHERE regexp_matches(text, '\S') AND NOT (kind = 'list' AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(x, '(?i)^\s*[-*]\s+\*\*(Source video|Duration|Sentences kept):\*\*'))) = 0)),
told AS (SELECT *, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS bare, lead(kind) OVER (PARTITION BY name, section ORDER BY block) AS follows FROM own),
joints AS (SELECT *, CASE WHEN follows IS NULL THEN NULL WHEN regexp_matches(bare, '^\d+[.)]$') THEN ' ' WHEN regexp_matches(bare, '^#{1,6}[ \t]+\S') OR bare LIKE '%|' THEN NULL
    WHEN kind = 'para' AND bare LIKE '%:' THEN CASE WHEN follows = 'list' THEN E'\n\n' END
    WHEN NOT regexp_matches(bare, '[.!?]["''”’)]?$|:$') THEN CASE WHEN follows = 'para' THEN ' ' ELSE E'\n\n' END END AS post FROM told),
links AS (SELECT *, lag(post) OVER (PARTITION BY name, section ORDER BY block) AS pre FROM joints),
pieces AS (SELECT *, sum(CASE WHEN pre IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY name, section ORDER BY block ROWS UNBOUNDED PRECEDING) AS piece,
    CASE WHEN post IS NULL THEN CASE WHEN pre = ' ' THEN regexp_replace(text, '^\s+', '') ELSE text END WHEN pre IS NULL AND post = E'\n\n' THEN text ELSE bare END || coalesce(post, '') AS said FROM links)"""

ORACLE = {
    "note_facts": f"WITH {_MADE} SELECT name, regexp_replace(name, '\\.[^.]*$', '') AS title, CASE WHEN raw LIKE '---%' THEN 'Drill work,hips' ELSE '' END AS tags, length(body)::BIGINT AS n_chars FROM bodies",
    "note_blocks": f"WITH {_MADE}{_BLOCKS} SELECT name, block, kind, text FROM blocks",
    "note_sections": f"WITH {_MADE}{_BLOCKS}{_sections_sql()} SELECT name, section, array_to_string(path, ' > ') AS path, n_blocks, sections.body, CASE WHEN contains(lower(array_to_string(path, ' ')), 'drill') OR raw LIKE '---%' THEN 'hitting drill' "
    "WHEN regexp_matches(array_to_string(path, ' '), '(?i)\\b(what is|what does|explained|definition|means|versus|vs\\.?)\\b') THEN 'definition' ELSE 'hitting mechanics instruction' END AS content_type FROM sections JOIN bodies USING (name)",
    "note_pieces": f"WITH {_MADE}{_BLOCKS}{_sections_sql()}{_PIECES} SELECT name, section, piece::BIGINT AS n, arg_max(kind, block) AS kind, string_agg(said, '' ORDER BY block) AS text FROM pieces GROUP BY name, section, piece",
    # No look-behind there: a mark is put where a sentence ends.
    "note_sentences": r"""WITH marked AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '([.!?])["”'']?\s+([A-Z“"''(])', E'\\1\x01\\2', 'g'), E'\x01') AS parts FROM documents WHERE text IS NOT NULL),
told AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS parts FROM marked)
SELECT doc_id, unnest(range(len(parts)))::BIGINT AS n, unnest(list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '^[\s.:,;!?)\]]+', ''), '\s+$', ''))) AS sentence FROM told""",
}
