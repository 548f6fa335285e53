import base64
import hashlib
import random

import pytest
import tiktoken

from wayfold.llm import bpe

P = bpe.default_params()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.ranks, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(3)
    alphabet = "abcdeé ßñ中文字🙂\n\t  .,'012ßABC  \x1c\x1f\x85\x00'ss"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) for _ in range(150)]
    return [*out, None, "", " ", "a" * 20_000, "ab" * 3000, "é" * 999, "<|endoftext|>", "the quick brown fox's 1234567890!!" * 30, "x " * 5000, "a\u0558b \U00010d40's"]


def test_same_as_the_library(spark, reference):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, bpe.round_trip_digest(df, P).collect())) == want


def test_columns_and_bounded_memory(spark, reference):
    p = bpe.BpeParams(P.ranks, P.pattern, words_kept=5, chunk=3, slice_bytes=50)
    df = spark.createDataFrame([(1, "ab cd ef gh", "x", 2), (1, "ab cd ef gh", "x", 2), (None, None, None, None)], "doc_id long, text string, ids string, decoded long")
    got = bpe.decode(bpe.encode(df, p), p).collect()
    assert [bytes(r.decoded) for r in got if r.doc_id] == [b"ab cd ef gh"] * 2
    assert [list(r.ids) for r in got if r.doc_id] == [reference.encode_ordinary("ab cd ef gh")] * 2
    assert bpe.round_trip_digest(df.limit(0), p).count() == 0


@pytest.fixture(scope="module")
def codec():
    with open(P.ranks, "rb") as f:
        return bpe.Codec(f.read(), P)


def test_long_words(codec, reference):
    r = random.Random(8)
    words = ["".join(r.choice(a) for _ in range(n)) for a, n in (("abcdefghijklmnopqrstuvwxyzABCDEF", 100_000), ("ACGT", 20_000), ("aé", 3000), ("ing", 2000), ("=", 7777))]
    words += ["".join(r.choice("abc") for _ in range(r.randint(60, 700))) for _ in range(60)]
    got = codec.words(words)
    assert [" ".join(x) for x in got] == [" ".join(map(str, reference.encode_ordinary(w))) for w in words]
    assert [codec.bytes_of(x) for x in got] == [w.encode() for w in words]


def test_decoded_bytes_come_from_the_ids(codec, monkeypatch):
    with open(P.ranks, "rb") as f:
        other = bpe.Codec(f.read(), P)
    honest = other._contract

    def wrong(words):
        out = honest(words)
        return [([x[0], *x[2:]], " ".join(map(str, [x[0], *x[2:]]))) if len(x) > 2 else (x, t) for x, t in out]

    text = "unquestionablyxq mispronounceablez"
    assert codec.bytes_of(codec.words([text])[0]) == text.encode()
    monkeypatch.setattr(other, "_contract", wrong)
    assert other.bytes_of(other.words([text])[0]) not in (text.encode(), b"")
