"""Byte-level BPE with a two-tier lookup.

Tier one resolves whole pre-tokens that are in the vocabulary through a minimal perfect hash; tier two merges the bytes
of the others with a heap over linked bytes. Both work on the distinct pre-tokens of a batch, whole arrays at a time
for tier one; ids and bytes are then gathered back per text. Rows are independent, so there is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column, kind_of, quoted, table, whole_text

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of texts whose pre-tokens are held at once, and merged pre-tokens that a worker remembers.
BATCH_CHARS = 1 << 22
REMEMBERED = 1 << 20
#: Keys to a bucket, on average, while the perfect hash is built.
LOAD = 4

# The general pattern, for texts all below U+0100, spelled out in classes for the faster engine: letters, numbers, spaces.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _mix(h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    x = h + np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of n byte strings to 0..n-1: each bucket has a displacement that puts its keys on free places.

    Unknown keys land anywhere, so find() compares the key itself.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // LOAD)
        hashes = np.array([xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("equal keys, or equal hashes of keys")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        self.displacement = np.zeros(self.buckets, np.uint64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own, base, many = hashes[order[starts[b] : starts[b] + sizes[b]]], 0, 16
            while True:
                tries = np.arange(many, dtype=np.uint64)
                at = (_mix(own[None, :], (tries + np.uint64(base))[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~taken[at].any(axis=1)
                if len(own) > 1:
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if hit.size:
                    self.displacement[b] = base + int(hit[0])
                    taken[at[hit[0]]] = True
                    break
                base, many = base + many, min(4 * many, 1 << 10)
        self.keys: list[bytes] = [b""] * n
        self.value = np.zeros(n, np.int64)
        for i, p in enumerate(self._place(hashes)):
            self.keys[p], self.value[p] = keys[i], i

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (_mix(hashes, self.displacement[(hashes % np.uint64(self.buckets)).astype(np.int64)]) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key, -1 for keys that aren't among those hashed."""
        if not keys or not self.n:
            return np.full(len(keys), -1, np.int64)
        at = self._place(np.fromiter(map(xxh64_intdigest, keys), np.uint64, len(keys)))
        own = self.keys
        known = np.fromiter((own[p] == k for p, k in zip(at.tolist(), keys, strict=True)), bool, len(keys))
        return np.where(known, self.value[at], -1)


class Encoder:
    """Encodes and decodes with the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip()))
        self.ranks = np.array([r for r, _ in ranked], np.int64)
        self.tokens = [t for _, t in ranked]
        self.hash = PerfectHash(self.tokens)
        number = {t: i for i, t in enumerate(self.tokens)}
        self.bytes = [number[bytes([b])] for b in range(256)]
        self.pairs = {}
        for i, t in enumerate(self.tokens):
            for cut in range(1, len(t)):
                a, b = number.get(t[:cut]), number.get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = i
        self.spell = np.empty(int(self.ranks.max()) + 1, object)
        self.spell[self.ranks] = self.tokens
        self.latin = pattern == public_tokenizers.PATTERN
        self.pattern = regex.compile(pattern)
        self.merged: dict[bytes, list[int]] = {}
        self.earlier: dict[bytes, list[int]] = {}

    def pretokens(self, text: str) -> list[str]:
        return LATIN.findall(text) if self.latin and text and max(text) < "Ā" else self.pattern.findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Token numbers of one pre-token: the lowest-ranked pair of neighbours merges first, the leftmost of equals."""
        known, own = self.pairs.get, self.bytes
        ids = [own[b] for b in piece]
        n = len(ids)
        shift = n.bit_length()
        places = (1 << shift) - 1
        # want[i] is what the pair that begins at i merges to, so a heap entry that says otherwise is out of date
        want = [known(a << 20 | b) for a, b in zip(ids, ids[1:], strict=False)]
        heap = [m << shift | i for i, m in enumerate(want) if m is not None]
        if not heap:
            return ids
        want.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            top = heappop(heap)
            m, i = top >> shift, top & places
            if want[i] != m:
                continue
            j = after[i]
            ids[i], ids[j], want[i], want[j] = m, -1, None, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = want[i] = known(m << 20 | ids[k])
                if r is not None:
                    heappush(heap, r << shift | i)
            p = before[i]
            if p >= 0:
                r = want[p] = known(ids[p] << 20 | m)
                if r is not None:
                    heappush(heap, r << shift | p)
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        pieces: list[str] = []
        ends = []
        for text in texts:
            pieces += self.pretokens(text)
            ends.append(len(pieces))
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = [p.encode() for p in coded.dictionary.to_pylist()]
        at = coded.indices.to_numpy(zero_copy_only=False)
        whole = self.hash.find(distinct)
        counts = np.ones(len(distinct), np.int64)
        flat: list = []
        missed = np.flatnonzero(whole < 0)
        if len(self.merged) + len(missed) > REMEMBERED // 2:
            self.earlier, self.merged = self.merged, {}
        memory, earlier = self.merged, self.earlier
        for i in missed.tolist():
            piece = distinct[i]
            ids = memory.get(piece)
            if ids is None:
                ids = memory[piece] = earlier.get(piece) or self.merge(piece)
            counts[i] = len(ids)
            flat.extend(ids)
        starts = np.cumsum(counts) - counts
        held = np.zeros(int(counts.sum()), np.int64)
        held[starts[whole >= 0]] = whole[whole >= 0]
        other = np.repeat(whole < 0, counts)
        held[other] = flat
        n = counts[at]
        first = np.cumsum(n) - n
        ids = self.ranks[held[np.repeat(starts[at], n) + np.arange(int(n.sum())) - np.repeat(first, n)]].astype("<u4")
        bounds = np.append(first, len(ids))[np.array([0, *ends])]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.spell[ids].tolist())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder to a worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= BATCH_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """The columns in `keep`, n_tokens, ids_sha256, decoded_sha256 and, unless with_ids is false, ids (array of long).

    ids are those of the whole text without special tokens; decoded_sha256 is the digest of the bytes that the ids give
    when decoded, equal to the text's own. A null text counts as empty and gives no ids. One row per input row, repeated
    rows included; an empty table gives an empty one. Columns that aren't in `keep` are not read.

    vocabulary: the rank file's path, public_tokenizers.path(VOCABULARY) if None; it must be on every machine.
    """
    file = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(file or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in _blocks(texts):
                ids = code.encode(texts[a:b])
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(code.decode(x)).hexdigest() for x in ids])]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{quoted(c)} {kind_of(docs, c)}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    return docs.select(*(column(docs, c) for c in keep), whole_text(text).alias("_text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """The columns in `keep` and text (string), the text whose ids the column ids holds; null ids give the empty text."""
    file = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(file or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            texts = [code.decode(np.array(x or [], np.int64)).decode(errors="replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    schema = ", ".join(f"{quoted(c)} {kind_of(encoded, c)}" for c in keep)
    return encoded.select(*(column(encoded, c) for c in keep), column(encoded, "ids").cast("array<long>")).mapInArrow(run, f"{schema}, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op8_bpe": op8_bpe}
