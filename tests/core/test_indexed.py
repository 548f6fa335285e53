"""The index, scan and path operators against plain Python on small random tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import cfg, grams, layout, reachability, scans, search
from wayfold.storage import materialize


def closure(edges):
    nodes = {x for e in edges for x in e if x is not None}
    out = {n: {b for a, b in edges if a == n and b is not None} for n in nodes}
    seen = {}
    for n in nodes:
        got, stack = {n}, [n]
        while stack:
            for m in out[stack.pop()] - got:
                got.add(m)
                stack.append(m)
        seen[n] = got
    return seen


GRAPHS = {
    "random": [(random.Random(1).randrange(30) if i % 9 else i, random.Random(i).randrange(30)) for i in range(40)],
    "two cycles and a tail": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (0, 1)],
    "chain": [(i, i + 1) for i in range(6)],
    "nulls, loops, repeats": [(1, 1), (1, 2), (1, 2), (None, 3), (4, None), (2, 1)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_reach_index(spark, tmp_path, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src int, dst int")
    seen = closure([e for e in edges if None not in e])
    # endpoints of dropped edges are no nodes unless another edge names them
    assert {r.id: r.scc for r in reachability.scc_labels(df).collect() if r.id in seen} == {n: min(m for m in seen[n] if n in seen[m]) for n in seen}
    pairs = [(a, b) for a in [*seen, 99, None] for b in [*seen, 99, None]]
    asked = spark.createDataFrame([*pairs, (99, 99)], "a int, b int").withColumn("landmark", F.lit("x"))
    for first in (0, 3) if name == "random" else (1,):
        index = reachability.reach_index(df, first)
        got = {(r.a, r.b): r.reaches for r in reachability.reach_by_labels(index, asked).collect()}
        assert got == {(a, b): a is not None and b is not None and (a == b or b in seen.get(a, ())) for a, b in pairs}
    index.save(str(tmp_path / "index"))
    again = reachability.reach_by_labels(reachability.load_index(spark, str(tmp_path / "index")), asked)
    assert again.count() == len(pairs) + 1 and {(r.a, r.b): r.reaches for r in again.collect()} == got


def test_reach_index_of_nothing(spark):
    index = reachability.reach_index(spark.createDataFrame([], "src int, dst int"))
    got = reachability.reach_by_labels(index, spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, True), (1, 2, False)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_scans(spark, seed):
    r = random.Random(seed)
    parts = [0] if seed == 0 else [None, "a", "b", "c"]
    rows = [(i, str(r.choice(parts)) if seed == 0 else r.choice(parts), r.randrange(50), r.choice([None, None, None, r.randrange(9)])) for i in range(300)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "id int, part string, at int, v int, _range int, ordinal int").repartition(5)
    want = {}
    for p in {x[1] for x in rows}:
        last, n, total = None, 0, None
        for i, _, _, v in sorted((x for x in rows if x[1] == p), key=lambda x: (x[2], x[0])):
            last = v if v is not None else last
            total = total if v is None else (total or 0) + v
            want[i] = (last, n, total)
            n += (v or 0) > 3
    carried = {x.id: x.v for x in scans.carry_forward(df, "v", "part", ["at", "id"]).collect()}
    counted = {x.id: x.ordinal for x in scans.count_before(df, F.col("v") > 3, "part", ["at", "id"]).collect()}
    summed = {x.id: x.total for x in scans.running_sum(df, F.col("v"), "part", ["at", "id"]).collect()}
    assert {i: (carried[i], counted[i], summed[i]) for i in want} == want
    assert scans.carry_forward(df, "v", "part", "id").columns == df.columns
    assert scans.carry_forward(df.limit(0), "v", "part", "id").count() == 0 == scans.count_before(df.limit(0), F.lit(True), "part", "id").count()


def test_contains_pairs(spark):
    r = random.Random(4)
    word = lambda a, b: "".join(r.choice("ab中 🙂") for _ in range(r.randint(a, b)))
    needles = [(i, word(0, 5)) for i in range(60)] + [(100, None), (101, ""), (102, "zz"), (103, "a")]
    texts = [(i, word(0, 30)) for i in range(60)] + [(200, None), (201, ""), (202, "a" * 5000)]
    texts += [(300, texts[3][1])]
    n, t = spark.createDataFrame(needles, "n int, needle string"), spark.createDataFrame(texts, "t int, text string")
    got = sorted((x.n, x.t) for x in grams.contains_pairs(n, t, "needle", "text").collect())
    assert got == sorted((a, b) for a, x in needles for b, y in texts if x and y and x in y) and len(got) > 100
    once = sorted((x.n, x.t) for x in grams.contained_once(n, t, "needle", "text", "n").collect())
    assert once == sorted(p for p in got if sum(p[0] == q[0] for q in got) == 1)
    assert grams.contains_pairs(n.limit(0), t, "needle", "text").count() == 0 == grams.contains_pairs(n, t.limit(0), "needle", "text").count()


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    r = random.Random(5)
    words = ["Stone", "gate", "North", "门", "ring", "a", "x1"]
    rows = [(i, " ".join(r.choice(words) for _ in range(3)), r.choice(["k", None]), r.choice(["West", "", None]), r.choice([None, "b1"])) for i in range(80)]
    nodes = spark.createDataFrame(rows, "id int, label string, kind string, region string, floor string")
    names = spark.createDataFrame([("door", "gate"), ("门", "stone"), ("doors", "ring north"), ("none", "absent")], "alias string, target string")
    grams.write_index(nodes, str(tmp_path / "index"), buckets=4)
    index = grams.read_index(spark, str(tmp_path / "index"))
    for q in ("gate", "GATE north", "doo", "门 a", "1", "absent", "west stone gate", "stone gate"):
        for aliases in (None, names):
            assert list(map(tuple, grams.indexed_search(index, q, aliases, 500).collect())) == list(map(tuple, search.search(nodes, q, aliases, 500).collect())), q
    assert grams.indexed_search(index, " ").count() == 0
    assert grams.indexed_text_filter(index, "E\nnORT").count() == 0 and grams.indexed_text_filter(index, "").count() == 80
    assert grams.indexed_text_filter(index, "E NORT").count() == nodes.filter("lower(label) like '%e nort%'").count() > 0


def depth_first(ways, goal, most, steps):
    """The order and the cuts that the levels must give."""
    paths, cut, stack = [], False, [(0, (), frozenset())]
    while stack:
        at, trace, seen = stack.pop()
        if at == goal:
            paths.append(list(trace))
            if len(paths) >= most:
                return paths, cut or bool(stack)
        elif at not in ways or at in seen or len(trace) > steps:
            cut = True
        else:
            stack += [(t, trace + ((f"{at}:{k}",) if k else ()), seen | {at}) for t, k in reversed(ways[at]) if t is not None]
    return paths, cut


@pytest.mark.parametrize("most, steps, together", [(32, 512, 64), (3, 512, 2), (4, 3, 1)])
def test_paths_are_depth_first(spark, most, steps, together):
    r = random.Random(most + steps)
    rows, goals, want = [], [], {}
    for ev in range(14):
        n, ways = r.randint(1, 9), {}
        for i in range(n):
            kind = r.random()
            if kind < 0.4:
                b = [(i + 1 if i + 1 < n else None, None)]
            elif kind < 0.8:
                b = [(r.randrange(n), "condition_true"), (i + 1, "condition_false")]
            else:
                b = [(r.choice([None, r.randrange(n + 2)]), f"k{j}") for j in range(r.randint(1, 3))]
            ways[i] = b
            rows += [("m", ev, i, t, k, j) for j, (t, k) in enumerate(b)]
        for g in {r.randrange(n + 1), n - 1, 0}:
            goals.append(("m", ev, g))
            want[ev, g] = depth_first(ways, g, most, steps)
    b = spark.createDataFrame(rows, "map_id string, event_id long, index int, target int, taken string, rank int")
    t = spark.createDataFrame(goals + goals[:2], "map_id string, event_id long, target_index int")
    got = {}
    for x in cfg.bounded_paths(b, t, most, steps, together).orderBy("path").collect():
        paths, _ = got.setdefault((x.event_id, x.target_index), ([], x.truncated))
        if x.path is not None:
            assert x.path == len(paths)
            paths.append(list(x.trace))
    assert got == want


def pushed(points, least, rounds=90):
    """One sequential run over a group's (id, x, y)."""
    xy = [[x, y] for _, x, y in sorted(points)]
    for _ in range(rounds):
        moved = False
        for i in range(len(xy)):
            for j in range(i + 1, len(xy)):
                dx, dy = xy[j][0] - xy[i][0], xy[j][1] - xy[i][1]
                size = math.hypot(dx, dy)
                if size < least:
                    ux, uy = (dx / size, dy / size) if size > 1e-9 else (math.cos(i + j), math.sin(i + j))
                    step = (least - size) / 2
                    xy[i], xy[j], moved = [xy[i][0] - ux * step, xy[i][1] - uy * step], [xy[j][0] + ux * step, xy[j][1] + uy * step], True
        if not moved:
            break
    return {i: tuple(p) for (i, _, _), p in zip(sorted(points), xy, strict=True)}


def test_repelled_as_in_one_run(spark):
    r = random.Random(3)
    rows = [(g, i, r.uniform(0, 120), r.uniform(0, 120)) for g, n in (("a", 60), ("b", 25), (None, 5)) for i in range(n)]
    rows += [("a", 100 + i, 50.0, 50.0) for i in range(6)] + [("c", 1, 0.0, 0.0)]
    df = spark.createDataFrame([(*x, "t", 1) for x in rows] + [("a", 900, None, 1.0, "t", 1), ("a", 901, math.nan, 1.0, "t", 1)], "g string, id int, x double, y double, part string, cells int")
    out = layout.repel(df, "g", 10.0)
    got = {(x.g, x.id): (x.x, x.y) for x in out.collect()}
    assert out.columns == df.columns and len(got) == len(rows) + 2 and got.pop(("a", 900)) == (None, 1.0) and got.pop(("a", 901))[1] == 1.0
    for g in ("a", "b", "c", None):
        for i, p in pushed([x[1:] for x in rows if x[0] == g], 10.0).items():
            assert got[g, i] == pytest.approx(p, abs=1e-6), (g, i)
    assert layout.repel(df.limit(0), "g", 10.0).count() == 0


def test_paths_of_small_events_take_no_rounds(spark, monkeypatch):
    rng = random.Random(7)
    kinds = [("GOTO IF X", 1, None), ("GOTO Unconditionally", 2, None), ("SKIP IF Y", None, 1), ("END IF Z", None, None), ("Label 1", None, None), ("Label", 2, None), ("SET", None, None), ("SKIP Z", None, 2)]
    rows = [("m", e, i, *rng.choice(kinds)) for e in range(60) for i in range(rng.randint(1, 14)) if e % 7 or i != 3]
    b = materialize(cfg.successors(spark.createDataFrame(rows, "map_id string, event_id long, index int, name string, label int, skip int")))
    goal = spark.createDataFrame([("m", e, g) for e in range(61) for g in (0, 5, 9)], "map_id string, event_id long, target_index int")
    written = []
    monkeypatch.setattr(cfg, "materialize", lambda df, name="table": (written.append(name), materialize(df, name))[1])
    told = lambda most, **how: sorted(map(str, cfg.bounded_paths(b, goal, most_paths=most, most_steps=6, **how).collect()))
    one, few = told(32), told(2)
    assert written == ["targets", "tried"] * 2  # before, some tables for each straight run of the longest path
    assert one == told(32, small=0) and few == told(2, visits=12)
    assert any("truncated=True" in x for x in one) and any("path=1" in x for x in one)


def _written(monkeypatch):
    written = []
    monkeypatch.setattr(reachability, "materialize", lambda df, name="table": (written.append(name), materialize(df, name))[1])
    return written


def test_components_take_a_quarter_of_the_rounds(spark, monkeypatch):
    ring = [(i, (i + 1) % 20) for i in range(20)]
    edges = ring + [(i, 100) for i in range(20, 50)] + [(100, i) for i in range(50, 80)] + [(3, 20), (60, 61), (61, 60), (60, 90)]
    written = _written(monkeypatch)
    got = {r.id: r.scc for r in reachability.scc_labels(spark.createDataFrame(edges, "src int, dst int")).collect()}
    seen = closure(edges)
    assert got == {n: min(m for m in seen[n] if n in seen[m]) for n in seen}
    assert written.count("colours") + written.count("members") < 20  # before, a round for each node of the ring forwards, and again backwards
    hub = spark.createDataFrame([(i, 100) for i in range(30)] + [(100, i) for i in range(50, 80)] + [(50, 90), (90, 91)], "src int, dst int")
    ways = {(r.src, r.dst): r.low for r in reachability._shortened(hub).collect()}
    assert len(ways) == 62 + 3 and ways[100, 90] == ways[100, 91] == 50  # the hub itself joins no ways


def test_labels_take_a_quarter_of_the_rounds(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(16)]
    written = _written(monkeypatch)
    index = reachability.reach_index(spark.createDataFrame(chain, "src int, dst int"), first=1)
    pairs = [(a, b) for a in range(17) for b in range(17)]
    got = {(r.a, r.b): r.reaches for r in reachability.reach_by_labels(index, spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {(a, b): a <= b for a, b in pairs}
    assert written.count("labels") + written.count("asked") < 20  # before, a round for each edge of the chain
