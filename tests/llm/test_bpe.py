import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "a", "hello world", "  two  spaces\n\n x", "don't we'll I'VE 1234 5,6", "naïve été — ½ ² ª", "日本語 テキスト 😀👩‍👩‍👧", "\x1c\x1d a\x85b c", "a" * 5000, " " * 3000, "<|endoftext|>", "\t\r\n \x0b\x0c", "Ünïcödé " * 50]


def test_equals_library(library):
    code = bpe.encoder(PATH)
    for t, ids in zip(TEXTS, code.encode(TEXTS), strict=True):
        assert ids.tolist() == library.encode_ordinary(t), t[:30]
        assert code.decode(ids) == t.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, text):
    assert bpe.encoder(PATH).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_random_words(library):
    random.seed(0)
    texts = [" ".join("".join(random.choices("abcdeéß,.-'|0", k=random.randint(1, 14))) for _ in range(300)) for _ in range(20)]
    for t, ids in zip(texts, bpe.encoder(PATH).encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t)


def test_perfect_hash():
    for n in (0, 1, 2, 5, 1000):
        keys = [f"key{i}".encode() for i in range(n)]
        h = bpe.PerfectHash(keys)
        assert h.find(keys).tolist() == list(range(n))
        assert (h.find([b"other", b"", b"key-1"]) == -1).all()


def test_query_rows(docs_of, library):
    texts = [*TEXTS, None, "hello world"]
    rows = {r.doc_id: r for r in bpe.encode_texts(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (rows[i].n_tokens, list(rows[i].ids)) == (len(ids), ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_texts(docs_of(texts))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table(docs_of):
    assert bpe.encode_texts(docs_of([])).count() == 0


def test_merged_pieces_in_use_are_kept(monkeypatch):
    """A piece that each block asks for is merged once, however many others come and go."""
    import public_tokenizers

    from braidwork.llm import bpe

    code, merged = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY)), []
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    monkeypatch.setattr(code, "merged", {})
    monkeypatch.setattr(code, "merge", lambda piece: merged.append(piece) or bpe.Encoder.merge(code, piece))
    for block in range(12):
        texts = [f"qzxvkjqzx{'qzxw'[i % 4]}{'vkjz'[i // 4]}{chr(97 + block)}" for i in range(15)]
        assert [code.decode(x).decode() for x in code.encode([*texts, "zzqxjkvzz"])] == [*texts, "zzqxjkvzz"]
    assert merged.count(b"zzqxjkvzz") == 1 and len(merged) == 12 * 15 + 1
