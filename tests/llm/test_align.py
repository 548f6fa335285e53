import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wayfold.llm import align as A
from wayfold.llm.speculate import byte_letters

P = A.default_params()


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(P.first.tokenizer)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=P.second)


def tokens(libraries, text):
    """[(id, bytes)] of both libraries; none if the text is empty or not given back."""
    first, second = libraries
    letters = byte_letters()
    if not text:
        return [], []
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(libraries, rows):
    """The contract with all pairs of a document's tokens."""
    every, counts = [], Counter()
    for d, t in rows:
        a, b = map(spans, tokens(libraries, t))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        cuts, groups, low = sorted({x[2] for x in a} & {y[2] for y in b}), [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, u, v in side if low <= u and v <= c) for side in (a, b)))
            low = c
        every.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for d, n_a, n_b, n_groups, links, text in every:
        n_best, total = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
        out.append((d, n_a, n_b, n_groups, len(links), n_best, total, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def sample(seed, n=60):
    r = random.Random(seed)
    words = ["the", "unrelated", "tokenisation", "ab", "xyzzy", "é", "naïve", "中文", "🙂", "\n", "\t", "  ", "1234567", "don't", "!!", "\x00", " ", "ﬁ", "\t \n", " \n", "\n ", "\xa0", "<s>", "<0x41>", "<|endoftext|>"]
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 25))) for _ in range(n)]
    out += ["".join(chr(r.choice([r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000), 32, 97])) for _ in range(20)) for _ in range(n)]
    return [*out, None, "", " ", "a▁b", "▁", "é" * 300, " two  spaces  ", "中" * 200, "x" * 400]


@pytest.mark.parametrize("size, chars", [(4 << 20, 1 << 19), (200, 30), (1, 1)])
def test_same_as_brute_force(spark, libraries, size, chars):
    rows = list(enumerate(sample(size))) + [(3, sample(size)[3])] * 2 + [(None, "the end")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, links string, slice long, n_best int").repartition(3)
    p = A.AlignParams(P.first, P.second, slice_bytes=size, piece_chars=chars)
    assert sorted(map(tuple, A.alignment_digest(df, p).collect()), key=str) == brute(libraries, rows)


def test_whole_outputs(spark, libraries):
    rows = list(enumerate(sample(9, 20)))
    df = spark.createDataFrame([(d, t, [d], {"k": d}) for d, t in rows], "doc_id long, text string, `a b` array<long>, times map<string, long>")
    got = {r.doc_id: r for r in A.align(df, P).collect()}
    assert set(got) == {d for d, _ in rows} and all(r["a b"] == [d] for d, r in got.items())
    want = {r[0]: r for r in brute(libraries, rows)}
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == want[d][7] for d, r in got.items())
    counts = Counter()
    for _, t in rows:
        a, b = map(spans, tokens(libraries, t))
        counts.update((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    assert {(r.a_id, r.b_id): r.n for r in A.id_pairs(df, P).collect()} == dict(counts)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.alignment_digest(df, P).count() == 0 and A.id_pairs(df, P).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, A.alignment_digest(df, P).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_one_group_as_long_as_the_text(spark, libraries):
    # bytes of two-byte letters: B falls back to bytes where A has tokens of its own
    rows = [(1, "ܐܒ" * 3000), (2, "=" * 40_000), (3, "word " * 20_000)]
    got = A.alignment_digest(spark.createDataFrame(rows, "doc_id long, text string"), P).collect()
    for r in got:
        a, b = tokens(libraries, rows[r.doc_id - 1][1])
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(ends[0] & ends[1]), len(ends[0] | ends[1]))


def test_components_of_any_graph():
    r = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (50, 30), (400, 390), (1000, 3000)):
        x, y = r.integers(0, n, m), r.integers(0, n, m)
        root = list(range(n))
        for _ in range(n):
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                root[a] = root[b] = min(root[a], root[b])
        # a path in an order that needs many rounds
        assert A.components(x, y, n).tolist() == root
    order = r.permutation(5000)
    assert set(A.components(order[1:], order[:-1], 5000).tolist()) == {0}
