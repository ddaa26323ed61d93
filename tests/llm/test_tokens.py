"""Encoding against the public libraries, decoding as a round trip."""

import base64
import os
import random

import pytest

from graphlens.llm.tokens import DEFAULT_VOCABULARY, BytePairs, decode_corpus, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = [
    None, "", " ", "  \n ", "a", "it's 'll 'tis we'Ve DON'T 's", " 's", "!'s", "  's", "x  y\n\n z", "\t\tif  x:\r\n", "naïve café №12 ½", "模块 layerset 的覆盖率 2%", "👩‍💻👨‍👩‍👧 \u200b\u00ad",
    "مرحبا 649 שלום", "<|endoftext|>", "\x00\x1c\x85\u2028", "a" * 3000, "word " * 3000, "ไม่พบไฟล์", "１２３ ｆｕｌｌ"]


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_corpus(spark):
    ref = reference()
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(1000, "a", "x", 1)] * 2, "doc_id long, text string, ids string, id long")
    got = [(r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()]
    assert sorted(got) == sorted([(i, ref.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)] + [(1000, ref.encode_ordinary("a"))] * 2)
    back = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert encode_corpus(df.limit(0)).collect() == []


def test_random_texts():
    ref, own = reference(), BytePairs(DEFAULT_VOCABULARY, cache=50)
    r = random.Random(2)
    texts = ["".join(r.choice("ab1 ''\n\t sredvlmtZé_!  😀") for _ in range(r.randrange(80))) for _ in range(3000)]
    assert own.encode_batch(texts)[0] == [ref.encode_ordinary(t) for t in texts]


def test_offsets():
    own = BytePairs(DEFAULT_VOCABULARY)
    ids, offs = own.encode_batch(["Hello  world's end", None], True)
    starts, at = offs[0][::2], offs[0][1::2]
    assert ["Hello  world's end"[a:b] for a, b in zip(starts, starts[1:] + [99])] == ["Hello", " ", " world", "'s", " end"]
    pieces = own.pieces
    assert b"".join(pieces[x] for x in ids[0][at[2]:at[3]]) == b" world" and offs[1] == []
