"""Token counts through a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens). Contents are joined with it by digest; only distinct
contents without a stored count are encoded, and their counts are appended. One task encodes one copy of a content, however
many documents hold it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, shared_dir, table, whole_text

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
_LOADED: dict = {}


def tokenizer_digest(path: str) -> str:
    """Changes whenever the tokenizer's file or its library's version does."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\n" + f.read()).hexdigest()


def counter(path: str):
    """texts -> their numbers of tokens, by the library that reads the file; loaded once to a worker."""
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _LOADED[path] = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    return _LOADED[path]


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The cache's counts for one tokenizer version; None before anything was stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def contents(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(_keep, _text, content): the columns in `keep` as one struct, the text, null made empty, and its SHA-256."""
    own = docs.select(F.struct(F.lit(0).alias("_"), *(column(docs, c) for c in keep)).alias("_keep"), whole_text(text).alias("_text"))
    return own.withColumn("content", F.unhex(F.sha2("_text", 256)))


def store(own: DataFrame, cache: str, tokenizer: str | None = None) -> None:
    """Encodes those distinct contents of own (content, _text) that the cache has no count for, and appends theirs."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    version = tokenizer_digest(path)
    distinct = own.select("content", "_text")
    known = _stored(own.sparkSession, cache, version)
    if known is not None:
        distinct = distinct.join(known, "content", "left_anti")
    distinct = distinct.groupBy("content").agg(F.first("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    distinct.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", tokenizer: str | None = None, cache: str | None = None) -> DataFrame:
    """The columns in `keep`, n_bytes (UTF-8) and n_tokens (both long), one row per input row.

    A null text counts as empty, an empty one has no tokens. The content is the text itself, null made empty: any further
    normalisation could change counts. Copies and repeated rows share one count; an empty table gives an empty one and
    appends nothing. Columns may have any names; `keep` must not name n_bytes or n_tokens.

    tokenizer: path of a .model (sentencepiece) or .json (tokenizers) file, on every machine. cache: the table's folder, on
    storage that driver and executors share; None begins a new one in the shared folder. Runs that overlap can both
    append a content's count; readers take one of the equal counts.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer or public_tokenizers.path(TOKENIZER))
    cache = cache or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    own = contents(docs, keep, text)
    store(own, cache, tokenizer)
    # Written out, one row a content: a join that has no sum below it can split the rows of a text that is copied often.
    counts = materialize(_stored(spark, cache, version), "token-counts")
    sized = own.select("_keep", F.octet_length("_text").cast("long").alias("n_bytes"), "content")
    return sized.join(counts, "content").select(*(F.col("_keep").getField(c).alias(c) for c in keep), "n_bytes", "n_tokens")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's contents come in two deliveries with one cache: the first half of all digests, then the whole table, whose
    stored digests are found and whose other ones are encoded and appended."""
    docs, cache = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    store(contents(docs).where("substring(content, 1, 1) < X'80'"), cache)
    return count_tokens(docs, cache=cache).withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op4_tokens": op4_tokens}
