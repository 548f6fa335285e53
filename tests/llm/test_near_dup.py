import random

import pytest

from wayfold.llm.near_dup import NearDupParams, near_duplicates

WS = " \t\n\x0b\f\r"


def brute(rows):
    def items(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in WS:
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {d: items(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def sample(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)] + ["The", "the", "x"]
    rows, base = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 20, 80, 150]))]
        base.append(w)
        rows.append((i, r.choice(WS).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A  b")]


@pytest.mark.parametrize("leaders", [32, 1])
def test_same_as_brute_force(spark, leaders):
    rows = sample(leaders)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, bands int")
    got = near_duplicates(df, NearDupParams(leaders=leaders)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_chain_and_edges(spark):
    """A chain of small edits is one component although its ends differ; odd rows have their result."""
    w = [f"t{i}" for i in range(100)]
    chain = []
    for i in range(12):
        v = list(w)
        v[: i * 3] = [f"z{j}" for j in range(i * 3)]
        chain.append((i, " ".join(v)))
    df = spark.createDataFrame([*chain, (50, "q r s"), (50, "q r s"), (None, "q r s"), (60, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert {x[2] for x in got if x[0] is not None and x[0] < 12} == {0}
    assert [x for x in got if x[0] == 50] == [(50, 1, 50, True)] * 2
    assert (60, 0, 60, True) in got and [x[3] for x in got if x[0] is None] == [False]
    assert near_duplicates(df.limit(0)).count() == 0
