"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much text goes as well.

Native: DataFrame expressions only. No row leaves its task; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, packed, table, whole_text, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST = 0.5
#: A line fails on punctuation when more than this share of its non-space characters are symbols or exclamation marks.
MAX_SYMBOL_SHARE = 0.15
SYMBOLS = "[#*$%&|<>]"
#: Marks that a line of prose uses sparingly.
LINE_MARKS = r"[#*$%&|<>!?^~=_{}\\]"
#: Three or more short cells between bars, chevrons or bullets.
NAVIGATION = r"^[^|»›•·]{0,40}([|»›•·][^|»›•·]{0,40}){2,}$"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved|copyright ©|privacy policy|cookie policy|terms of use|terms of service|click here|"
    "enable javascript|subscribe to our newsletter|sign in to continue|skip to content|back to top"
)
#: A line fails on boilerplate when such phrases make up at least this share of its non-space characters.
MIN_BOILERPLATE_SHARE = 0.2


def line_fails(line: Column, max_symbol_share: float = MAX_SYMBOL_SHARE, boilerplate: str = BOILERPLATE) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule. A line without a word breaks none."""
    solid = F.length(F.regexp_replace(line, SPACE_CLASS + "+", ""))
    marks = F.regexp_count(line, F.lit(LINE_MARKS))
    low = F.lower(line)
    rest = F.regexp_replace(F.regexp_replace(low, boilerplate, ""), SPACE_CLASS + "+", "")
    furniture = low.rlike(boilerplate) & (F.length(rest) <= F.lit(1 - MIN_BOILERPLATE_SHARE) * F.length(F.regexp_replace(low, SPACE_CLASS + "+", "")))
    return (solid > 0) & (
        (marks > F.lit(max_symbol_share) * solid)
        | ~line.rlike(r"[\p{L}\p{N}]")
        | line.rlike(NAVIGATION)
        | furniture
    )


def repeated_words(df: DataFrame, words: str, out: str, window: int = WINDOW) -> DataFrame:
    """Adds the number of words inside word windows that occur twice or more in the text.

    A window is found by a 64-bit hash of its words' hashes. Only a text with equal hashes sorts them, each with its place;
    the places of equal hashes alone are then sorted by the words themselves. Neighbours of equal words give the places that
    count, and the union of the intervals of `window` words is summed.
    """
    n = F.size(words)
    df = df.withColumn("_wh", F.transform(words, lambda w: F.xxhash64(w)))
    hashed = F.transform(F.sequence(F.lit(0), F.size("_wh") - window), lambda i: F.xxhash64(*[F.get("_wh", i + k) for k in range(window)]))
    df = df.withColumn("_gh", F.when(n >= window, hashed))
    twice = F.size(F.array_distinct("_gh")) < F.size("_gh")
    df = df.withColumn("_ph", F.when(twice, F.array_sort(F.transform("_gh", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    alike = F.filter("_ph", lambda x, k: F.coalesce(x["h"] == F.get("_ph", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_ph", k + 1)["h"], F.lit(False)))
    df = df.withColumn("_sg", F.array_sort(F.transform(alike, lambda x: F.struct(x["h"].alias("h"), F.slice(words, x["i"] + 1, window).alias("w"), x["i"].alias("i")))))
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))
    hit = F.filter("_sg", lambda x, k: same(x, F.get("_sg", k - 1)) | same(x, F.get("_sg", k + 1)))
    df = df.withColumn("_at", F.array_sort(F.transform(hit, lambda x: x["i"])))
    m = F.greatest(F.size("_at"), F.lit(1))
    steps = F.zip_with(F.slice("_at", 1, m - 1), F.slice("_at", 2, m - 1), lambda a, b: F.least(b - a, F.lit(window)))
    covered = F.aggregate(steps, F.lit(window).cast("long"), lambda s, x: s + x)
    return df.withColumn(out, F.when(F.col("_at").isNull() | (F.size("_at") == 0), F.lit(0)).otherwise(covered).cast("long")).drop("_wh", "_gh", "_ph", "_sg", "_at")


def clean(
    docs: DataFrame,
    text: str = "text",
    max_lost: float = MAX_LOST,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_symbol_share: float = MAX_SYMBOL_SHARE,
    boilerplate: str = BOILERPLATE,
) -> DataFrame:
    """One row per input row with every input column (struct `doc`) and q_words, q_word_chars, q_symbols, q_dup_lines,
    q_repeat_words, base_failed, q_lost, cleaned_text, kept.

    A null text counts as empty: no words, base_failed, not kept, cleaned to the empty text. Repeated rows are judged
    each on its own. Lines without a word stay. q_lost is the share of non-space characters in failing lines, 0 for an
    empty text. An empty table gives an empty one. Columns of the input cannot clash: they are held in `doc`.
    """
    df = docs.select(packed(docs, "doc"))
    df = df.withColumn("_t", F.coalesce(F.col("doc").getField(text).cast("string"), F.lit("")))
    df = df.withColumn("_w", words_of(F.col("_t")))
    df = df.withColumn("q_words", F.size("_w").cast("long"))
    df = repeated_words(df, "_w", "q_repeat_words").drop("_w")
    df = df.withColumn("q_word_chars", F.length(F.regexp_replace("_t", SPACE_CLASS + "+", "")).cast("long"))
    df = df.withColumn("q_symbols", F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long"))
    df = df.withColumn("_l", F.split("_t", "\n"))
    df = df.withColumn("_v", F.filter("_l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("q_dup_lines", (F.size("_v") - F.size(F.array_distinct("_v"))).cast("long")).drop("_v")
    df = df.withColumn("_k", F.filter("_l", lambda x: ~line_fails(x, max_symbol_share, boilerplate)))
    df = df.withColumn("cleaned_text", F.when(F.size("_k") == F.size("_l"), F.col("_t")).otherwise(F.array_join("_k", "\n")))
    rest = F.length(F.regexp_replace("cleaned_text", SPACE_CLASS + "+", ""))
    df = df.withColumn("q_lost", F.when(F.col("q_word_chars") == 0, F.lit(0.0)).otherwise(1 - rest / F.col("q_word_chars")))
    df = df.withColumn("base_failed", (F.col("q_words") < min_words) | (100 * F.col("q_repeat_words") > max_repeat_percent * F.col("q_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("q_lost") <= max_lost))
    # The generator keeps filters on the verdict above it: pushed down, they would repeat every expression in it many times over.
    told = F.struct("q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "base_failed", "q_lost", "cleaned_text", "kept")
    return df.select("doc", F.explode(F.array(told)).alias("_q")).select("doc", "_q.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select(
        F.col("doc.doc_id").alias("doc_id"),
        F.col("q_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
    )


def oracle() -> dict[str, str]:
    space = r"[\x20\x09-\x0D]+"
    boiler, nav, marks = BOILERPLATE, NAVIGATION, LINE_MARKS
    return {
        "op10_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
l AS (SELECT rid, text, unnest(string_split(text, chr(10))) AS line FROM d),
s AS (SELECT rid, line, length(regexp_replace(line, '{space}', '', 'g')) AS solid FROM l),
v AS (SELECT rid,
        sum(CASE WHEN solid > 0 THEN 1 ELSE 0 END) - count(DISTINCT CASE WHEN solid > 0 THEN line END) AS dup,
        sum(solid) AS chars,
        sum(CASE WHEN solid > 0 AND (length(regexp_replace(line, '{marks.replace("[", "[^")}', '', 'g')) > {MAX_SYMBOL_SHARE} * solid
              OR NOT regexp_matches(line, '[\p{{L}}\p{{N}}]') OR regexp_matches(line, '{nav}') OR (regexp_matches(lower(line), '{boiler}')
                  AND length(regexp_replace(regexp_replace(lower(line), '{boiler}', '', 'g'), '{space}', '', 'g')) <= {1 - MIN_BOILERPLATE_SHARE} * length(regexp_replace(lower(line), '{space}', '', 'g')))) THEN solid ELSE 0 END) AS lost
      FROM s GROUP BY rid),
o AS (SELECT d.doc_id, len(w.w) AS n_words, v.chars AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        v.dup AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, v.lost
      FROM d JOIN w USING (rid) JOIN v USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost <= {MAX_LOST} * word_chars AS kept
FROM o"""
    }


QUERIES = {"op10_quality": op10_quality}
