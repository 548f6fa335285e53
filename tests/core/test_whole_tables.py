"""Queries over whole tables: ids beyond the small tables' take part too."""

from wayfold.plans import workload


def test_narrow_candidates_of_every_order(spark, tmp_path):
    orders, parts = [1, 1999, 2000, 149_501], [(1, "Brand#4", 30), (501, "Brand#4", 10), (1001, "Brand#5", 40), (500, "Brand#1", 1), (1499, "Brand#1", 26), (999, "Brand#2", 2)]
    spark.createDataFrame([(o,) for o in orders], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = []
    for o in orders:
        rows = [x for x in parts if x[0] % 500 == o % 500]
        for rule in (lambda x: x[1] == "Brand#4", lambda x: x[2] > 25):
            rows = [x for x in rows if rule(x)] or rows
        want += [(o, x[0]) for x in rows]
    assert sorted(map(tuple, workload.narrow_candidates(spark, str(tmp_path)).collect())) == sorted(want)


def test_narrow_by_key_makes_result_rows_only(spark):
    """Null conditions count as false; no operator sees all pairs of a key."""
    from pyspark.sql import functions as F

    from wayfold.operators import relational as R

    queries = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(9000, None)], "q long, k int")
    candidates = spark.createDataFrame([(i, i % 2, None if i % 3 else i < 8, i % 5 == 0) for i in range(300)] + [(999, None, True, True)], "c long, k int, f boolean, g boolean")
    got = R.narrow_by_key(queries, candidates, "k", F.col("f"), F.col("g")).select("q", "c")
    want = R.narrow(queries.join(candidates, "k"), "q", F.col("f"), F.col("g")).select("q", "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_offset_histogram_of_every_customer(spark, tmp_path):
    customers, suppliers = [(1, 0), (2999, 1), (3000, 0), (14_999, 1)], [(5, 0), (7, 1), (2004, 0)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {}
    for c, n in customers:
        for s, m in suppliers:
            if n == m:
                want[c - s] = want.get(c - s, 0) + 1
    assert {r.k: r.n for r in workload.offset_histogram(spark, str(tmp_path)).collect()} == want


def test_offset_histogram_of_dense_and_sparse_blocks(spark):
    """As many offsets as pairs of values, for values of any sign, repeated, null and far apart; without a row for each pair."""
    import numpy as np
    from pyspark.sql import functions as F

    from wayfold.operators import relational as R

    rng = np.random.default_rng(7)
    a = [(k, int(v)) for k in (0, 1) for v in rng.integers(-70_000, 70_000, 4000)] + [(1, 10**15), (1, 10**15), (0, None), (None, 3), (2, 4)]
    b = [(k, int(v)) for k in (0, 1) for v in rng.integers(-3_000, 140_000, 3000)] + [(1, -(10**15)), (1, None), (None, 3), (0, 5)]
    want: dict = {None: 0}
    for key in (0, 1):
        x, y = ([v for k, v in t if k == key] for t in (a, b))
        k, n = np.unique(np.subtract.outer([v for v in x if v is not None], [v for v in y if v is not None]), return_counts=True)
        for i, m in zip(k.tolist(), n.tolist(), strict=True):
            want[i] = want.get(i, 0) + m
        want[None] += len(x) * len(y) - int(n.sum())
    left, right = spark.createDataFrame(a, "k int, a long"), spark.createDataFrame(b, "k int, b long")
    got = R.offset_histogram(left, right, "k", "a", "b")
    assert {r.k: r.n for r in got.collect()} == want
    assert "mapinpandas" in got._jdf.queryExecution().executedPlan().toString().lower()  # no join of values
    halves = R.offset_histogram(left.withColumn("a", F.col("a") / 2), right, "k", "a", "b").filter("k is null").first()
    assert halves.n == want[None]


def test_named_points_of_hot_names(spark):
    """Every name has all points of the other kind twice; the join has one row a variant, not one a point."""
    from pyspark.sql import functions as F

    from wayfold.operators import evidence

    names = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 2, ["a", "a"]), (3, 1, ["c"]), (4, None, ["c", None]), (5, 1, ["d"]), (6, 3, ["e", "f"]), (7, 1, ["g"])], "id int, region int, variants array<string>")
    points = [("a", 1, 10), ("a", 1, 10), ("a", 2, 11), ("a", 2, 12), ("b", 1, 10), ("c", 2, 13), ("c", None, 13), ("d", 1, None), ("d", 2, 14), ("e", 1, 15), ("f", 2, 15)] + [("h", 9, i) for i in range(500)]
    points = spark.createDataFrame(points, "name string, region int, point int")
    got = evidence.name_points(names, points)
    assert {r.id: r.point for r in got.collect()} == {1: 10, 2: None, 3: 13, 4: 13, 5: 14, 6: 15, 7: None}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate [name")  # points are reduced below the join


def test_common_branches_of_one_order(spark, tmp_path):
    """A list that meets no other keeps what it repeats, as in SQL."""
    import duckdb

    from wayfold.plans import evidence

    spark.createDataFrame([(15, 1), (15, 2), (16, 2), (7, 3), (22, 3), (31, 4)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    sql = workload.ORACLE_SQL["common_branches"].replace("FROM orders", f"FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = sorted(duckdb.connect().execute(sql).fetchall())
    assert ("0,0,7" in dict(want).values()) and sorted(map(tuple, evidence.common_branches(spark, str(tmp_path)).collect())) == want


def test_string_tables_of_large_files(spark, tmp_path):
    """Two files of many texts each, made and read in linear time."""
    import time

    from wayfold.plans import reports

    n = 60_000
    rows = spark.range(n).selectExpr("id as p_partkey", "concat('name ', id % 97) as p_name", "concat('Brand#', id % 2) as p_brand")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    t = time.monotonic()
    got = reports.string_tables(spark, str(tmp_path)).collect()
    assert time.monotonic() - t < 60
    want = [(f"Brand#{b}", 101 + i, f"name {(2 * i + b) % 97}中") for b in (0, 1) for i in range(n // 2)]
    assert sorted((r.path, r.id, r.text) for r in got if r.path != "broken") == want and len(got) == n + 1


def test_repelled_crowd_and_chain(spark):
    """A crowd of thousands is moved in near-linear time, and a chain of parts that meet one after another needs few rounds."""
    import time

    import numpy as np

    from wayfold.operators import layout

    rng = np.random.default_rng(3)
    xy, t = rng.integers(0, 14_000, (10_000, 2)) / 10.0, time.monotonic()
    one = xy.copy()
    layout._push_apart(one, np.arange(len(xy)), 12.0, 10)
    assert time.monotonic() - t < 15
    few = xy[:400] / 10
    want = few.copy()
    for _ in range(5):
        for i in range(len(few) - 1):
            for j in range(i + 1, len(few)):
                d = want[j] - want[i]
                size = float(np.hypot(*d))
                if size < 12.0:
                    unit = d / size if size > 1e-9 else np.array([np.cos(i + j), np.sin(i + j)])
                    want[i] -= unit * (12.0 - size) / 2
                    want[j] += unit * (12.0 - size) / 2
    got = few.copy()
    layout._push_apart(got, np.arange(len(few)), 12.0, 5)
    assert np.allclose(got, want)
    # pairs that are pushed towards the next pair: each joins its neighbour only after it has moved
    rows = [("g", 2 * i + e, 27.0 * i + 0.5 * e, 0.0) for i in range(64) for e in (0, 1)]
    whole = np.array([[x, y] for _, _, x, y in rows])
    layout._push_apart(whole, np.arange(len(rows)), 10.0, 90)
    runs, connected = [], layout.connected_components
    layout.connected_components = lambda *a: (runs.append(1), connected(*a))[1]
    try:
        out = layout.repel(spark.createDataFrame(rows, "g string, id int, x double, y double"), "g", 10.0).orderBy("id").collect()
    finally:
        layout.connected_components = connected
    assert [(r.x, r.y) for r in out] == [tuple(p) for p in whole.tolist()] and len(runs) <= 9


def test_contained_words_of_copies(spark, tmp_path):
    """Texts go to no join of pairs: copies are searched once and met again by their digest; letters beyond 16 bits count as one."""
    from wayfold.operators import grams

    texts = [(i, "ab𝄞cd long text " + "x" * 50 if i % 2 else f"other {i % 7} text") for i in range(200)] + [(900, None), (901, "")]
    needles = [(1, "b𝄞c"), (2, "text"), (3, "ab𝄞d"), (4, "𝄞"), (5, "r 3 t"), (6, None)]
    n, t = spark.createDataFrame(needles, "n int, needle string"), spark.createDataFrame(texts, "t int, text string")
    for size in (1, 3, 8):
        got = grams.contains_pairs(n, t, "needle", "text", size).select("n", "t")
        assert sorted(map(tuple, got.collect())) == sorted((a, b) for a, x in needles for b, y in texts if x and y and x in y)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan and "(text" not in plan.split("Join")[1].split("\n")[0]


def test_written_index_is_dealt(spark, tmp_path):
    """One small file of many rows becomes as many files as there are shuffle partitions, whose grams are many tasks' work."""
    from wayfold.operators import grams

    nodes = spark.range(0, 4000, 1, 1).selectExpr("id", "concat('name ', id) as label", "'k' as kind", "'r' as region")
    grams.write_index(nodes, f"{tmp_path}/index")
    index = grams.read_index(spark, f"{tmp_path}/index")
    assert len(index.rows.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert grams.indexed_text_filter(index, "me 399").count() == 11


def test_large_parts_have_tasks_of_their_own(spark, tmp_path, monkeypatch):
    """As many crowds as nations: before, some met in one task by the hash of their names, and each point told the cells that it passed."""
    from pathlib import Path

    from pyspark import TaskContext

    from wayfold.operators import layout

    seen = str(tmp_path)

    def noted(xy, place, least, rounds):
        Path(seen, f"{TaskContext.get().partitionId()}-{len(xy)}-{place[0]}-{xy[0, 0]}").touch()
        return {(int(x // 12.1), int(y // 12.1)) for x, y in xy}

    monkeypatch.setattr(layout, "_push_apart", noted)
    crowds = spark.range(25 * layout.LARGE + 300).selectExpr("cast(id % 25 as int) as g", "id", "id % 25 + id * 7919 % 1009 / 20.0 as x", "id * 104729 % 997 / 20.0 as y")
    assert layout.repel(crowds, "g", 12.0).count() == 25 * layout.LARGE + 300
    names = [p.name.split("-") for p in tmp_path.iterdir()]
    assert sorted(int(x[0]) for x in names) == list(range(25)) and all(int(x[1]) == layout.LARGE + 12 for x in names)


def test_repelled_crowd_equals_plain_run(spark):
    """A crowd with points in one place, by the plain rule; the cells told are those that some point was in."""
    import math

    import numpy as np

    from wayfold.operators import layout

    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(-40, 60, (160, 2)), np.zeros((3, 2))])
    place, wide = np.arange(len(xy)) * 2 + 1, layout._cell_width(12.0)
    want, cells = xy.tolist(), set()
    see = lambda p: cells.add((math.floor(p[0] / wide), math.floor(p[1] / wide)))
    list(map(see, want))
    for _ in range(12):
        for i in range(len(want)):
            for j in range(i + 1, len(want)):
                dx, dy = want[j][0] - want[i][0], want[j][1] - want[i][1]
                size, turn = math.hypot(dx, dy), float(place[i] + place[j])
                if np.hypot(dx, dy) < 12.0:
                    ux, uy = (dx / size, dy / size) if size > 1e-9 else (math.cos(turn), math.sin(turn))
                    px, py = ux * (12.0 - size) / 2, uy * (12.0 - size) / 2
                    want[i], want[j] = [want[i][0] - px, want[i][1] - py], [want[j][0] + px, want[j][1] + py]
                    see(want[i]), see(want[j])
    got = xy.copy()
    assert layout._push_apart(got, place, 12.0, 12) == cells and got.tolist() == want


def test_contained_once_meets_its_own_part_only(spark, monkeypatch):
    """Needles meet texts of their own part whole; before, each met all texts that held three of its digits, of any part."""
    import random
    from collections import Counter

    from wayfold.operators import grams
    from wayfold.storage import materialize

    r = random.Random(2)
    needles = [(r.choice([None, *range(400)]), r.choice([None, *range(6)]), str(r.randrange(1500)) if i % 40 else r.choice([None, "", "4321 and more 4321"])) for i in range(300)]
    texts = [(i, r.choice([None, *range(6)]), f"T#{r.randrange(1500):09d}" if i % 30 else r.choice([None, "", "x 4321 and more 4321", "T#1"])) for i in range(300)]
    texts += [(900 + i, *texts[i][1:]) for i in range(40)]
    told = []

    def noted(df, name="table"):
        out = materialize(df, name)
        told.append((name, out.count()))
        return out

    monkeypatch.setattr(grams, "materialize", noted)
    n, t = spark.createDataFrame(needles, "k int, g int, needle string"), spark.createDataFrame(texts, "t int, g int, text string")
    out = grams.contained_once(n, t, "needle", "text", "k", on=["g"])
    pairs = [(k, g, a, i, b) for k, g, a in needles for i, h, b in texts if g is not None and g == h and a and b and a in b]
    often = Counter(p[0] for p in pairs)
    want = [p for p in pairs if often[p[0]] == 1]
    assert out.columns == ["k", "g", "needle", "t", "text"] and sorted(map(repr, (tuple(x) for x in out.collect()))) == sorted(map(repr, want)) and len(want) > 5
    short = {(g, a, b) for _, g, a, _, b in pairs if len(a) <= grams.WHOLE}
    held = dict(told)["text_grams"]
    assert len(short) <= held <= len(short) + 16 * 20  # the rest are grams of the few long needles
    told.clear()
    every = grams.contains_pairs(n, t.withColumnRenamed("g", "h"), "needle", "text", 3)
    assert Counter((x.k, x.g, x.needle, x.t) for x in every.collect()) == Counter((k, g, a, i) for k, g, a in needles for i, _, b in texts if a and b and a in b)
