"""Media columns: texts as PNG images of 8-bit samples, their checked decoding, and low-frequency cosine-transform hashes.

Encoding and decoding run in Arrow batches; every row is handled on its own, so there is no shuffle and a lost executor
costs only its tasks.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, kind_of, quoted, table, whole_text

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Whole-image row filters that the encoder tries; the smallest stream stays, the first of equals.
FILTERS = (0, 2)
CHUNK = 1 << 16
GRID, LOW = 32, 8
MEDIA_SCHEMA = "n_bytes long, payload_bytes long, media binary, phash binary"


class MediaError(ValueError):
    """A stored image whose signature, chunk checksum, header or length is wrong."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """The rows under one of PNG's filters 0 (none), 1 (left) or 2 (up), each led by its filter byte."""
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = rows
    if kind == 1:
        out[:, 2:] -= rows[:, :-1]
    elif kind == 2:
        out[1:, 1:] -= rows[:-1]
    elif kind:
        raise ValueError(f"the encoder has no filter {kind}")
    return out


def encode_png(payload: bytes, width: int = WIDTH, filters: tuple[int, ...] = FILTERS, level: int = 6) -> bytes:
    """payload, a positive multiple of width, as a grey PNG of 8-bit samples, width to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    stream = min((zlib.compress(_filtered(rows, f).tobytes(), level) for f in filters), key=len)
    head = struct.pack(">IIBBBBB", width, rows.shape[0], 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK)]
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(parts) + _chunk(b"IEND", b"")


def unfilter(raw: np.ndarray) -> np.ndarray:
    """Undoes PNG's row filters 0 to 4 for one byte a pixel; raw has the filter byte first in each row.

    Rows filtered against their left neighbour need no other row: one running sum undoes them all. A run of rows
    filtered against the row above is one running sum down the columns. Average and Paeth rows go byte by byte.
    """
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise MediaError("unknown row filter")
    left = kinds == 1
    if left.any():
        out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)], strict=True):
        if kinds[a] == 2:
            block = out[max(a - 1, 0) : b]
            out[max(a - 1, 0) : b] = np.cumsum(block, axis=0, dtype=np.uint8)
        elif kinds[a] in (3, 4):
            for r in range(a, b):
                above = out[r - 1].tolist() if r else [0] * out.shape[1]
                line, w, nw = out[r].tolist(), 0, 0
                for i, n in enumerate(above):
                    if kinds[r] == 3:
                        guess = (w + n) >> 1
                    else:
                        p = w + n - nw
                        dw, dn, dd = abs(p - w), abs(p - n), abs(p - nw)
                        guess = w if dw <= dn and dw <= dd else n if dn <= dd else nw
                    w, nw = (line[i] + guess) & 255, n
                    line[i] = w
                out[r] = line
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG, rows by columns; raises MediaError on any checksum or length that doesn't hold."""
    if media[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    at, stream, head = 8, [], None
    while True:
        if at + 12 > len(media):
            raise MediaError("the chunks end early")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data, end = media[at + 8 : at + 8 + n], at + 12 + n
        if end > len(media) or struct.unpack_from(">I", media, end - 4)[0] != zlib.crc32(kind + data):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            stream.append(data)
        elif kind == b"IEND":
            break
        at = end
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not grey samples of 8 bits")
    width, height = head[:2]
    unpack, size = zlib.decompressobj(), height * (width + 1)
    try:
        raw = unpack.decompress(b"".join(stream), size + 1)
    except zlib.error as e:
        raise MediaError(str(e)) from None
    if len(raw) != size or not unpack.eof:
        raise MediaError("the samples' length")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _basis() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.rint(np.cos(math.pi * (2 * x + 1) * k / (2 * GRID)) * (1 << 12)).astype(np.int64)


BASIS = _basis()


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest frequencies of a 32 by 32 reduction lie above their median (the mean level aside).

    All in whole numbers, so that equal samples give equal hashes on every machine.
    """
    height, width = samples.shape
    rows = np.arange(GRID) * height // GRID
    tall = np.diff(np.append(rows, height)).clip(1)
    sums = np.add.reduceat(samples.astype(np.int64), rows, axis=0)  # for fewer rows than GRID: a row as often as needed
    cols = np.arange(GRID) * width // GRID
    wide = np.diff(np.append(cols, width)).clip(1)
    small = np.add.reduceat(sums, cols, axis=1) * 256 // (tall[:, None] * wide[None, :])
    low = (BASIS @ small @ BASIS.T).ravel()
    return np.packbits(low > np.sort(low[1:])[31]).tobytes()


def payload_of(text: str) -> tuple[int, bytes]:
    data = text.encode()
    return len(data), data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_bytes, payload_bytes, media (the PNG), phash (8 bytes), one row per input row.

    A null text counts as empty, and an empty one as 64 zero bytes. Equal texts give equal media and hashes; repeated
    rows give repeated rows; an empty table gives an empty one. Only key and text are read, so other columns can't clash.
    """
    kind = kind_of(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    n, payload = payload_of(text)
                    media = encode_png(payload)
                    rows.append((n, len(payload), media, cosine_hash(decode_png(media))))
                n, size, media, phash = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(media, pa.binary()), pa.array(phash, pa.binary())], [key, "n_bytes", "payload_bytes", "media", "phash"])

    return docs.select(column(docs, key), whole_text(text).alias("text")).mapInArrow(run, f"{quoted(key)} {kind}, {MEDIA_SCHEMA}")


def media_digests(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads stored images back, checksums tested, and gives digests of payload and image and the hash as hex digits."""
    kind = kind_of(stored, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media"):
                data = media.as_py()
                samples = decode_png(data)
                payload = samples.tobytes()
                rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples).hex()))
            out = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *map(pa.array, out, kinds)], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select(column(stored, key), "n_bytes", "payload_bytes", "media").mapInArrow(run, f"{quoted(key)} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(encode_media(table(spark, sf_dir, "documents")))


QUERIES = {"op1_media": op1_media}
