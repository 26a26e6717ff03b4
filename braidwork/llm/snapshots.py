"""Difference of two snapshots of a table whose keys may have changed.

Rows of both sides are made narrow (a digest for each compared column) and dealt by key hash; in each partition DuckDB
joins them in full. Rows without a partner are numbered within their content and dealt by content hash and number; there
DuckDB pairs what is equal, nulls with nulls only. No text is shuffled, nothing goes to the driver, and no group, not even
one that holds a third of all rows, is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, kind_of, materialize, quoted, table
from .ranks import parts_of, per_partition, ranked


def _digest(df: DataFrame, name: str) -> Column:
    """32 bytes, null for null."""
    return F.unhex(F.sha2(column(df, name).cast("string").cast("binary"), 256))


def _side(df: DataFrame, side: int, key: str, columns: Sequence[str], content: Sequence[str], carry: Sequence[str]) -> DataFrame:
    digests = df.select(column(df, key).alias("key"), *(_digest(df, c).alias(f"d{i}") for i, c in enumerate(columns)), *(column(df, c).alias(f"c{i}") for i, c in enumerate(carry)))
    whole = F.concat(*(F.coalesce(F.hex(f"d{columns.index(c)}"), F.lit("~")) for c in content))
    return digests.select(F.lit(side).alias("side"), "*", F.unhex(F.sha2(whole, 256)).alias("g"))


def _by_key(rows: DataFrame, ds: list[str]) -> DataFrame:
    """rows with nr, the row's number among its side's rows of that key: 1 but where keys repeat."""
    repeated = materialize(rows.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k")).distinct(), "repeated-keys")
    if repeated.isEmpty():
        return rows.withColumn("nr", F.lit(1).cast("long"))
    same = F.col("key").eqNullSafe(F.col("k"))
    alone = rows.join(repeated.hint("merge"), same, "left_anti").withColumn("nr", F.lit(1).cast("long"))
    many = materialize(rows.join(repeated.hint("merge"), same, "left_semi"), "rows-of-repeated-keys")
    return alone.unionByName(ranked(many, ["side", "key"], ds))


def difference(earlier: DataFrame, later: DataFrame, key: str, columns: Sequence[str], content: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per pair or unpaired row: key (the later row's, else the earlier's), old_key (the earlier's, else null), op,
    changed (the differing columns of `columns`, comma-joined in that order; else empty), and of the later row (null
    for a delete) the columns in `carry`.

    Equal keys pair: `same`, or `update` if a column differs. Of the other rows, those equal in all columns of `content`
    pair as `rekey`: the i-th smallest earlier key with the i-th largest later key. The rest are `insert` and `delete`.

    Nulls equal nulls only, in keys as well; a null key is smaller than any other. Repeated keys: the i-th row of a key
    pairs with the i-th of the other side, in the order of the SHA-256 digests of `columns`; equal rows are
    interchangeable. Empty texts are values like any other, texts of any length cost 32 bytes a side. Empty tables give
    inserts, deletes or no rows. `columns` are of simple types and are compared as strings; `carry` has such types as well.
    Other columns are not read, and columns may have any names.
    """
    columns, content, carry = list(columns), list(content), list(carry)
    ds, cs, parts = [f"d{i}" for i in range(len(columns))], [f"c{i}" for i in range(len(carry))], parts_of(earlier)
    kind = kind_of(earlier, key)
    kinds = ", ".join(f"{c} {kind_of(later, name)}" for c, name in zip(cs, carry, strict=True))
    lacking = [c for c in carry if c not in earlier.columns]
    earlier = earlier.select("*", *(F.lit(None).cast(later.schema[c].dataType).alias(c) for c in lacking)) if lacking else earlier
    rows = materialize(_side(earlier, 0, key, columns, content, carry).unionByName(_side(later, 1, key, columns, content, carry)), "sides")

    listed = lambda side, names: "".join(f", {side}.{n}" for n in names)
    changed = ", ".join(f"CASE WHEN a.{d} IS DISTINCT FROM b.{d} THEN '{name.replace(chr(39), chr(39) * 2)}' END" for d, name in zip(ds, columns, strict=True))
    cases = "".join(f", CASE WHEN b.side IS NULL THEN a.{d} ELSE b.{d} END AS {d}" for d in [*ds, "g"])
    sql = f"""SELECT a.side IS NOT NULL AS had, b.side IS NOT NULL AS has, a.key AS old_key, b.key AS new_key,
        CASE WHEN a.side IS NOT NULL AND b.side IS NOT NULL THEN concat_ws(',', {changed}) ELSE '' END AS changed{listed("b", cs)}{cases}
        FROM (SELECT * FROM rows WHERE side = 0) a FULL OUTER JOIN (SELECT * FROM rows WHERE side = 1) b ON {{on}}"""
    schema = f"had boolean, has boolean, old_key {kind}, new_key {kind}, changed string{', ' + kinds if cs else ''}" + "".join(f", {d} binary" for d in [*ds, "g"])
    keyed = _by_key(rows, ds).repartition(parts, "key", "nr")
    first = materialize(per_partition(keyed, sql.format(on="a.key IS NOT DISTINCT FROM b.key AND a.nr = b.nr"), schema), "by-key")

    def left(side: int) -> DataFrame:
        own = first.where("had AND NOT has" if side == 0 else "has AND NOT had")
        return materialize(own.select(F.lit(side).alias("side"), F.col("old_key" if side == 0 else "new_key").alias("key"), *cs, *ds, "g"), "unpaired")

    rest = ranked(left(0), ["g"], ["key"]).unionByName(ranked(left(1), ["g"], ["key"], descending=True))
    equal = " AND ".join(f"a.d{columns.index(c)} IS NOT DISTINCT FROM b.d{columns.index(c)}" for c in content)
    second = per_partition(rest.repartition(parts, "g", "nr"), sql.format(on=f"a.nr = b.nr AND {equal}"), schema)

    def told(found: DataFrame, both: Column) -> DataFrame:
        op = F.when(F.col("had") & F.col("has"), both).when(F.col("has"), "insert").otherwise("delete")
        key_ = F.when(F.col("has"), F.col("new_key")).otherwise(F.col("old_key"))
        return found.select(key_.alias("key"), "old_key", op.alias("op"), "changed", *(F.col(c).alias(name) for c, name in zip(cs, carry, strict=True)))

    return told(first.where("had AND has"), F.when(F.col("changed") == "", "same").otherwise("update")).unionByName(told(second, F.lit("rekey")))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source of a later state of documents, by the remainder of crc32 of the decimal doc_id by 25: 0
    drops the row, 1 appends `+` to its text, 2 swaps lang and source, 3 changes the key to -1-key, 4 does so and sets
    source null, 5 adds a copy under key -1-key. Rows without a doc_id stay as they are."""
    own = docs.select(*map(quoted, ("doc_id", "text", "lang", "source")), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 25, F.lit(24)).alias("r"))
    r, moved = F.col("r"), (-1 - F.col("doc_id")).cast("long")
    keys = F.when(r.isin(3, 4), F.array(moved)).when(r == 5, F.array(F.col("doc_id"), moved)).otherwise(F.array(F.col("doc_id")))
    return own.where("r <> 0").select(
        F.explode(keys).alias("doc_id"), F.when(r == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(r == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"), F.when(r == 2, F.col("lang")).when(r != 4, F.col("source")).alias("source"),
    )


def op12_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("text", "lang", "source")
    docs = table(spark, sf_dir, "documents").select("doc_id", *columns)
    told = F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in columns))
    after = later_snapshot(docs).withColumn("row_sha256", F.sha2(told, 256))
    return difference(docs, after, "doc_id", columns, ("text", "lang"), carry=("row_sha256",))


QUERIES = {"op12_snapshots": op12_snapshots}

#: One step of crc32 for a bit, eight for a byte; DuckDB has no such function.
_BIT = "list_reduce(list_prepend({x}, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda h, b: {_BIT.format(x='xor(h, b)')}), 4294967295)"


def oracle() -> dict:
    return {
        "op12_snapshots": f"""
WITH e AS (SELECT doc_id, text, lang, source, {_CRC} % 25 AS r FROM documents),
l AS (SELECT unnest(CASE WHEN r IN (3, 4) THEN [-1 - doc_id] WHEN r = 5 THEN [doc_id, -1 - doc_id] ELSE [doc_id] END) AS doc_id,
    CASE WHEN r = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN r = 2 THEN source ELSE lang END AS lang,
    CASE WHEN r = 2 THEN lang WHEN r <> 4 THEN source END AS source FROM e WHERE r <> 0),
s AS (SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS row_sha256 FROM l),
k AS (SELECT s.doc_id AS key, e.doc_id AS old_key, concat_ws(',', CASE WHEN e.text IS DISTINCT FROM s.text THEN 'text' END,
    CASE WHEN e.lang IS DISTINCT FROM s.lang THEN 'lang' END, CASE WHEN e.source IS DISTINCT FROM s.source THEN 'source' END) AS changed, row_sha256
    FROM e JOIN s ON e.doc_id = s.doc_id),
oe AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS nr FROM e WHERE doc_id NOT IN (SELECT key FROM k)),
os AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id DESC) AS nr FROM s WHERE doc_id NOT IN (SELECT key FROM k))
SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, row_sha256 FROM k
UNION ALL SELECT coalesce(os.doc_id, oe.doc_id), oe.doc_id, CASE WHEN oe.doc_id IS NULL THEN 'insert' WHEN os.doc_id IS NULL THEN 'delete' ELSE 'rekey' END,
    CASE WHEN oe.doc_id IS NOT NULL AND os.doc_id IS NOT NULL AND oe.source IS DISTINCT FROM os.source THEN 'source' ELSE '' END, os.row_sha256
    FROM oe FULL OUTER JOIN os ON oe.text IS NOT DISTINCT FROM os.text AND oe.lang IS NOT DISTINCT FROM os.lang AND oe.nr = os.nr"""
    }
