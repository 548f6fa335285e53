import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from wayfold.llm import vector_codes as V

SHAPE = "vec_id long, embedding array<double>, label int, code int, _label string"


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, with Python's integers and one loop for each sum; rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    books = [[list(cut(first[i], k)) for i in sorted(first)[:entries]] for k in range(parts)]

    def near(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for k, book in enumerate(books):
            met = {}
            for _, v, _ in kept:
                met.setdefault(near(cut(v, k), book)[0], []).append(cut(v, k))
            for e, vs in met.items():
                book[e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    coded = []
    for i, v, lab in kept:
        found = [near(cut(v, k), books[k]) for k in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), lab))
    fits = lambda x: x if x < 2**63 else None
    labels = {lab: [e for *_, e, x in coded if x == lab] for lab in {x for *_, x in coded}}
    total = {lab: fits(sum(e)) if all(x < 2**63 for x in e) else None for lab, e in labels.items()}
    return sorted([(i, c, fits(e), total[lab], sha) for i, c, e, lab in coded], key=str)


def answers(spark, rows, params=V.CodeParams()):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE).repartition(3)
    return sorted(map(tuple, V.code_digest(df, params).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("most", [0.01, 1.0, 3e4, 1e30])
def test_same_as_brute_force(spark, most):
    r = random.Random(int(most * 100))
    rows = [(i, [r.uniform(-most, most) for _ in range(32)], r.choice([0, 1, 1, 1, None])) for i in range(130)]
    rows += [(i + 200, list(rows[i][1]), 2) for i in range(20)]  # exact copies
    rows += [rows[3], rows[3], (7, [x / 2 for x in rows[7][1]], 1)]  # repeated rows, a key with two vectors
    rows += [(None, rows[5][1], 1), (500, None, 1), (501, [None] + rows[1][1][1:], 1), (502, [math.nan] * 32, 0), (503, [math.inf] * 32, 0)]
    assert answers(spark, rows) == brute(rows)


def test_ties_and_few_rows(spark):
    # integers 0 and 2 are equally far from 1, and fewer rows than entries make fewer entries
    rows = [(i, [x / 256] * 16, 0) for i, x in enumerate([0, 2, 1, 1, 2, 0])]
    assert answers(spark, rows) == brute(rows)
    assert answers(spark, rows, V.CodeParams(entries=2, rounds=1)) == brute(rows, entries=2, rounds=1)


def test_copies_of_the_first_key_do_not_hide_others(spark):
    rows = [(0, [0.5] * 16, 0)] * 90 + [(i, [i / 7] * 16, 1) for i in range(1, 70)]
    assert answers(spark, rows) == brute(rows)


def test_other_lengths_and_nothing(spark):
    rows = [(i, [i / 9] * 16, 0) for i in range(5)]
    odd = [(10, [1.0] * 15, 0), (11, [], 0), (12, [1.0] * 32, 0)]
    assert answers(spark, rows + odd) == brute(rows)
    assert answers(spark, odd[:2]) == []
    assert answers(spark, []) == []
    assert [r[:4] for r in answers(spark, [(None, [1.0] * 16, 0)])] == [(None, None, None, None)]


def test_many_labels_are_joined(spark):
    rows = [(i, [i / 9, -i / 7] * 8, i % 3) for i in range(40)]
    assert answers(spark, rows, V.CodeParams(broadcast_labels=1)) == brute(rows)


def test_norm_expansion_is_exact():
    r = np.random.default_rng(4)
    for most in (3, 2**20, 2**40):
        x, c = r.integers(-most, most, (50, 2, 3)), r.integers(-most, most, (2, 9, 3))
        codes, errors = V.nearest(x, c)
        far = [[[sum((int(a) - int(b)) ** 2 for a, b in zip(x[i, k], e, strict=True)) for e in c[k]] for k in range(2)] for i in range(50)]
        assert [[f.index(min(f)) for f in row] for row in far] == codes.tolist()
        assert [[min(f) for f in row] for row in far] == [[int(e) for e in row] for row in errors]


def test_decompress(spark):
    df = spark.createDataFrame([(i, [float(i), -i / 2.0] * 8, 0, 1, "x") for i in range(20)], SHAPE)
    vectors, n = V.kept_vectors(df)
    books = V.fit_codebooks(vectors)
    got = V.decompress(V.compress(vectors, books), books).collect()
    assert n == 16 and all(r.decoded == [float(r.vec_id), -r.vec_id / 2.0] * 8 and r.error == 0 for r in got)
