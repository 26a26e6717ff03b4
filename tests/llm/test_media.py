import hashlib
import struct
import zlib

import numpy as np
import pytest

from braidwork.llm import media


def test_round_trip_and_filters():
    rng = np.random.default_rng(0)
    for n in (64, 128, 64 * 100):
        payload = rng.integers(0, 256, n, np.uint8).tobytes()
        for filters in ((0,), (1,), (2,), (0, 1, 2)):
            assert media.decode_png(media.encode_png(payload, filters=filters)).tobytes() == payload


def test_unfilter_average_and_paeth():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 7)).astype(int)
    kinds = [4, 3, 2, 1, 0, 4, 2, 2, 3]
    raw = np.zeros((9, 8), np.uint8)
    for r in range(9):
        raw[r, 0] = kinds[r]
        for c in range(7):
            w, n, nw = image[r, c - 1] if c else 0, image[r - 1, c] if r else 0, image[r - 1, c - 1] if r and c else 0
            p = w + n - nw
            paeth = min((w, n, nw), key=lambda x: (abs(p - x),))
            raw[r, 1 + c] = (image[r, c] - {0: 0, 1: w, 2: n, 3: (w + n) // 2, 4: paeth}[kinds[r]]) % 256
    assert (media.unfilter(raw) == image).all()


def test_checksums_are_tested():
    good = media.encode_png(bytes(range(64)))
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(bad))
    with pytest.raises(media.MediaError):
        media.decode_png(good[:-5])


def test_hash_sees_low_frequencies():
    rng = np.random.default_rng(3)
    low = rng.normal(size=(8, 8))
    wave = media.BASIS.T @ low @ media.BASIS
    smooth = np.kron((wave - wave.min()) / np.ptp(wave) * 255, np.ones((2, 2))).astype(np.uint8)  # energy in all 64 frequencies
    noisy = np.clip(smooth + np.random.default_rng(2).integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda a, b: bin(int.from_bytes(a) ^ int.from_bytes(b)).count("1")
    assert bits(media.cosine_hash(smooth), media.cosine_hash(noisy)) <= 8
    assert bits(media.cosine_hash(smooth), media.cosine_hash(smooth[::-1])) > 8


def test_query_rows(docs_of):
    texts = ["", None, "a", "é" * 32, "x" * 64, "y" * 65, "long " * 30_000, "a"]
    rows = {r.doc_id: r for r in media.media_digests(media.encode_media(docs_of(texts))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(data), len(payload))
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert rows[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[2][1:] == rows[7][1:] and rows[0][1:] == rows[1][1:]


def test_empty_table(docs_of):
    assert media.media_digests(media.encode_media(docs_of([]))).count() == 0


def test_header_is_standard():
    png = media.encode_png(bytes(128))
    assert png[:8] == media.SIGNATURE and struct.unpack_from(">II", png, 16) == (64, 2)
