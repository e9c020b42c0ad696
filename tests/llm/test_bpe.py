"""Merge replay against the tiktoken library, and the round trip."""

import random
from struct import unpack

import public_tokenizers
import pytest
import regex
import tiktoken

from revlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


def texts():
    rng = random.Random(5)
    odd = ["", " ", "\n\n  x", "aaaa" * 50, "hahaha" * 40, "=" * 500, "a b  c\t\td\r\n e", "it's we'll I'D", "\x1c\x85  z　",
           "naïve façade ßtraße", "日本語のテキスト、漢字", "🙂👩‍👩‍👧‍👦 emoji", "١٢٣ ௧௨", "x" * 3000, "<|endoftext|> raw", "​́é", "\x00\x01"]
    pools = ["abcde ", "the and ing tion ", "éèàüößñ ", "01239.,;:!? ", "Ａ漢字かな한국어 ", "\n\t  .'’", "ababab", "ñaarr"]
    for _ in range(300):
        pool = rng.choice(pools) + rng.choice(pools)
        odd.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 80))))
    return odd


def test_equals_library(merges):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    got = bpe.encode_texts(merges, texts(), regex.compile(merges.pattern), {})
    for text, ids in zip(texts(), got):
        assert ids.tolist() == own.encode_ordinary(text), repr(text)


def test_lower_rank_opened_by_a_merge():
    """A vocabulary whose merged token opens a pair of lower rank than its own."""
    ranks = {bytes([i]): i for i in range(256)}
    for k, t in enumerate([b"bc", b"abab", b"cab", b"ab", b"aba", b"ababa", b"bab"]):
        ranks[t] = 256 + k
    m = bpe.Merges(ranks, r"\S+")
    assert m.lower
    own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    for w, ids in m.encode_words(set(words)).items():
        assert list(unpack(f"={len(ids) // 4}i", ids)) == own.encode_ordinary(w), w


def test_long_text_in_blocks(merges, monkeypatch):
    text = " ".join(texts())
    whole = bpe.encode_texts(merges, [text], regex.compile(merges.pattern), {})[0]
    monkeypatch.setattr(bpe, "CHUNK", 64)
    monkeypatch.setattr(bpe, "KEPT", 20)
    assert bpe.encode_texts(merges, [text, None], regex.compile(merges.pattern), {})[0].tolist() == whole.tolist()


def test_frame(spark):
    rows = [(1, "The cat, the cat"), (2, None), (None, "x"), (1, "The cat, the cat"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS tokens", "1 AS id", "2 AS data")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["data"]).decode()) for r in out) == sorted((i or 0, t or "") for i, t in rows)
    once = bpe.encode(df, PATH, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, out))
    empty = bpe.digests(df.where("false"), PATH, public_tokenizers.PATTERN)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
