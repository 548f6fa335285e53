import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from wayfold.llm import speculate as S

P = S.default_params()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.tokenizer)


@pytest.fixture(scope="module")
def codec():
    with open(P.tokenizer, "rb") as f:
        return S.Codec(f.read(), P)


def texts(seed=3, n=300):
    r = random.Random(seed)
    # the last ones are letters and digits of Unicode versions that the library may not know
    alphabet = "abcdefgh ijéßñ中文字🙂\n\t  .,'012ßABC  \x1c\x1f\x85\x00'ss" + "".join(map(chr, [0x558, 0x88F, 0x10D40, 0x11DE0, 0x3D000]))
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) for _ in range(n)]
    out += ["".join(r.choice(["ing", "the", "er", "in", " ", "a", "aa", "A", "==", "-", "0"]) for _ in range(r.randint(0, 90))) for _ in range(n)]
    out += ["".join(chr(r.choice([r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000), 32])) for _ in range(30)) for _ in range(n)]
    special = ["<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext|", " <|endoftext|> "]
    return [*out, *special, None, "", " ", "a" * 20_001, "ab" * 3000, "é" * 999, "=" * 7777, " " * 5000 + "x", "the quick brown fox's 1234567890!!" * 30]


def want(library, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    return out


def test_same_as_the_library(spark, library):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, S.round_trip_digest(df, P).collect())) == want(library, rows)


def test_special_strings_as_text(spark):
    plain = Tokenizer.from_file(P.tokenizer)
    plain.encode_special_tokens = True
    rows = [(0, "a<|endoftext|>b"), (1, "<|endoftext|>")]
    got = S.encode(spark.createDataFrame(rows, "doc_id long, text string"), S.default_params(special=False)).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [plain.encode(t, add_special_tokens=False).ids for _, t in rows]


def test_random_long_words(codec, library):
    r = random.Random(8)
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEF", "ACGT", "ab", "aé"):
        word = "".join(r.choice(alphabet) for _ in range(100_000))
        ids, counts = codec.encode([word])
        assert counts.tolist() == [len(ids)] and ids.tolist() == library.encode(word, add_special_tokens=False).ids


def test_compatible_is_what_encoding_the_pair_says(codec, library):
    r = np.random.default_rng(5)
    a, b = r.choice(codec.merges.sound, 4000), r.choice(codec.merges.sound, 4000)
    a[:1000] = b[:1000]
    data = [codec.decode(np.array([x, y]), np.array([2]))[0] for x, y in zip(a, b, strict=True)]
    ids, counts, _ = codec.merges._rounds(data)
    ends = np.append(0, np.cumsum(counts))
    exact = [ids[ends[i] : ends[i + 1]].tolist() == [a[i], b[i]] for i in range(len(a))]
    assert codec.merges.compatible(a, b).tolist() == exact and 0 < sum(exact) < len(exact)


def test_both_exact_ways_agree(codec):
    r = random.Random(2)
    words = [bytes(r.choice(b"abcing ther") for _ in range(r.randint(1, 60))) for _ in range(400)]
    one, two = codec.merges.exact(words, 1000), codec.merges.exact(words, 20)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()


def test_small_vocabulary_with_tokens_that_are_never_made():
    # "ba" is made before "ab", and "abc" only of "ab" and "c": greedy takes "abc" where merging does not
    base = np.full(256, 0)
    base[[97, 98, 99]] = [0, 1, 2]
    m = S.Merges({0: b"a", 1: b"b", 2: b"c", 3: b"ba", 4: b"ab", 5: b"abc", 6: b"cc"}, [(1, 0, 3), (0, 1, 4), (4, 2, 5)], base)
    assert m.sound.tolist() == [0, 1, 2, 3, 4, 5]  # no merge gives cc
    ids, counts = m.encode([b"babc", b"abc", b"bab", b"ccabc"])
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == [3, 1, 2]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])[1:]] == [[5], [3, 1], [2, 2, 5]]


def test_decoding_reads_the_ids(spark, codec):
    df = spark.createDataFrame([(1, [72, 5303]), (2, [5303, 72]), (3, [72, None, 99_999, -1]), (4, []), (5, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in S.decode(df, P).collect()}
    one = lambda *ids: codec.decode(np.array(ids), np.array([len(ids)]))[0].decode("utf-8", "replace")
    assert got == {1: one(72, 5303), 2: one(5303, 72), 3: one(72), 4: "", 5: ""} and got[1] != got[2]


def test_columns_and_bounded_memory(spark, library):
    p = S.SpeculateParams(P.tokenizer, P.pattern, words_kept=5, bytes_kept=20, slice_bytes=50, long_word=2)
    rows = [(1, "ab cd ef gh <|endoftext|>", "x", 2), (1, "ab cd ef gh <|endoftext|>", "x", 2), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    got = S.decode(S.encode(df, p), p).collect()
    assert [list(r.ids) for r in got if r.doc_id] == [library.encode(rows[0][1], add_special_tokens=False).ids] * 2
    assert [r.text for r in got if r.doc_id] == [rows[0][1]] * 2
    assert S.round_trip_digest(df.limit(0), p).count() == 0


def test_text_that_is_no_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert [r.text for r in S.decode(S.encode(df, P).drop("text"), P).collect()] == ["a�b"]
