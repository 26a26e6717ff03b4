"""Secret scans with multipart credential linking, in DataFrame expressions only.

Strong finds are reported by themselves. Weak parts (account identifiers, bare random strings, endpoints) are reported
only where the complementary parts stand within one scope: an interval join of the parts of a document. As a document's
parts are in one row, the join is made there: in the sorted places of the parts, those that begin before a scope's end less
those that end before its start are the parts in it, so that no pairs are made and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, packed, table
from .spans import apart, fixed, joined, locate, merged, numbered, within

#: Code points, at most, between a credential's central part and any other part of it.
SCOPE = 200
KINDS = ("assign", "access", "hex")
MASK = "[SECRET]"
# Fixed patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # as AKIA[A-Z0-9]+ of 20 or more characters: a run of that class ends all its matches alike
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"  # as whole runs of 24 or more
# Weak parts.
PART_ID = r"""(?<![A-Za-z0-9_])(?i:user(?:name)?|login|client_?id|account_?id|access_?key_?id|key_?id)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9_.@+-]{3,}+"""
PART_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]{0,63}[0-9])(?=[a-z0-9+/_-]{0,63}[A-Z])(?=[A-Z0-9+/_-]{0,63}[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}"
PART_ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]{1,20}|mongodb|redis|amqp)://[^\s"'<>]++|(?<![A-Za-z0-9.-])(?:[a-z0-9-]{1,63}\.){1,5}[a-z]{2,10}:[0-9]{2,5}(?![0-9])"""
WEAK = {"id": PART_ID, "secret": PART_SECRET, "endpoint": PART_ENDPOINT}


def _strong(df: DataFrame, text: str) -> DataFrame:
    """Adds `base`, the strong finds by start, then kind as listed."""
    plain = lambda m, b, a: {}  # noqa: E731, ARG005
    t = F.col(text)
    df = locate(df, text, ASSIGN, "_assign", lambda m, b, a: {"ok": F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6}, t.rlike("(?i)pass|secret|token|api"))
    df = locate(df, text, ACCESS, "_access", plain, t.contains("AKIA"))
    df = locate(df, text, HEX, "_hex", plain, t.rlike("[0-9a-f]{24}"))
    kinds = [("assign", F.filter("_assign", lambda s: s["ok"])), ("access", F.col("_access")), ("hex", F.col("_hex"))]
    every = F.concat(*(numbered(a, n, k) for n, (k, a) in enumerate(kinds)))
    return df.withColumn("base", F.array_sort(every)).drop("_assign", "_access", "_hex")


def _weak(df: DataFrame, text: str) -> DataFrame:
    """Adds `weak`, the weak parts that no strong find overlaps."""
    guards = {"id": r"(?i)(user|login|id|name)[\"']? {0,4}[:=]", "secret": "[A-Za-z0-9+/_-]{20}", "endpoint": "://|:[0-9]"}
    for part, pattern in WEAK.items():
        df = locate(df, text, pattern, f"_{part}", lambda m, b, a: {}, F.col(text).rlike(guards[part]))  # noqa: ARG005
    every = F.concat(*(numbered(F.col(f"_{part}"), n + len(KINDS), f"part_{part}") for n, part in enumerate(WEAK)))
    df = df.withColumn("_every", every).drop(*(f"_{part}" for part in WEAK))
    df = fixed(df, _parts=F.col("_every"), _found=F.col("base")).drop("_every", "base").withColumnRenamed("_found", "base")
    return df.withColumn("weak", apart(F.col("_parts"), F.col("base"))).drop("_parts")


#: What may stand for a credential's identifier, its secret, and the third part that bears it out.
ROLES = (("access", "part_id"), ("assign", "hex", "part_secret"), (*KINDS, "part_endpoint"))


def linked(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Adds `linked`: those of the weak parts (column weak) that complete a credential with each other or with strong finds
    (column base), by start.

    Two parts are in one scope if at most `scope` code points lie between them. A part is a centre if an identifier, a
    secret and either a strong find or an endpoint are in its scope, itself included. The weak parts in the scope of a
    centre are reported, and no others: scopes don't chain.
    """
    wide = F.transform(F.array_sort(F.concat("base", "weak")), lambda p: F.struct(*(p[c].alias(c) for c in ("start", "nr", "end", "kind")), (p["start"] - scope).alias("low"), (p["end"] + scope).alias("high")))
    of = lambda kinds: lambda p: p["kind"].isin(*kinds)
    every = [F.exists("_wide", of(kinds)) for kinds in ROLES]
    df = fixed(df, _wide=F.when(F.size("weak") > 0, wide))
    df = fixed(df, _parts=F.when(every[0] & every[1] & every[2], F.col("_wide"))).drop("_wide")
    for i, kinds in enumerate(ROLES):
        df = fixed(df, **{f"_r{i}": within(F.col("_parts"), F.filter("_parts", of(kinds)))})
    marked = F.zip_with("_parts", F.arrays_zip("_r0", "_r1", "_r2"), lambda p, r: F.struct(p.alias("p"), (r["_r0"] & r["_r1"] & r["_r2"]).alias("whole")))
    df = fixed(df, _centres=F.filter(marked, lambda x: x["whole"])["p"], _weak=F.filter("_parts", lambda p: p["nr"] >= len(KINDS)))
    near = F.zip_with("_weak", within(F.col("_weak"), F.col("_centres")), lambda p, r: F.struct(p.alias("p"), r.alias("near")))
    plain = F.transform(F.filter(near, lambda x: x["near"]), lambda x: F.struct(*(x["p"][c].alias(c) for c in ("start", "nr", "end", "kind"))))
    return df.withColumn("linked", F.coalesce(F.when(F.size("_centres") > 0, plain), F.slice("weak", 1, 0))).drop("_parts", "_r0", "_r1", "_r2", "_centres", "_weak")


def found_in(own: DataFrame, text: str, scope: int) -> DataFrame:
    """Adds base and spans to rows with a text that isn't null."""
    df = linked(_weak(_strong(own, text), text), scope)
    return fixed(df, spans=F.array_sort(F.concat("base", "linked"))).drop("weak", "linked")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", scope: int = SCOPE) -> DataFrame:
    """The columns in `keep`, base and spans (arrays of struct<start, nr, end, kind>), one row per input row.

    base holds the strong finds (assign, access, hex) by start, then kind; spans has the linked weak parts besides,
    sorted alike. Places are code points, ends exclusive. A null or empty text has none; finds of different kinds may
    overlap; repeated rows each get theirs; an empty table gives an empty one. Columns may have any names; `keep` must not
    name base or spans.
    """
    own = docs.select(F.struct(*(column(docs, c) for c in keep)).alias("_keep"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("_text"))
    found = found_in(own, "_text", scope)
    return found.select(*(F.col("_keep").getField(c).alias(c) for c in keep), "base", "spans")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every stretch that spans (by start) cover replaced by one mask."""
    stretches = merged(spans)
    ends = F.concat(F.array(F.lit(0).cast("long")), stretches["end"])
    piece = lambda s, e: F.concat(F.substr(text, (e + 1).cast("int"), (s["start"] - e).cast("int")), F.lit(mask))
    pieces = F.zip_with(stretches, F.slice(ends, 1, F.size(stretches)), piece)
    return F.concat(F.array_join(pieces, ""), F.substr(text, (F.array_max(spans["end"]) + 1).cast("int")))


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """docs with masks in place of secrets, and n_chars (if there is such a column) told anew where the text changed.

    Each row is scanned and masked by itself: whatever happens to tasks or partitions, no row can meet another's finds.
    Every row stays, repeated ones too; a null text stays null; an empty table gives an empty one. Other columns stay as
    they are, whatever their names. Of finds that overlap or touch the same stretch, one mask is left.
    """
    own = docs.select(packed(docs, "_doc"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("_body"))
    hit = found_in(own, "_body", scope)
    changed = F.size("spans") > 0
    hit = fixed(hit, _new=F.when(changed, masked(F.col("_body"), F.col("spans"), mask)))
    new = {text: F.when(changed, F.col("_new")).otherwise(F.col("_doc").getField(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_new")).otherwise(F.col("_doc").getField("n_chars"))
    return hit.select(*(new.get(c, F.col("_doc").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
