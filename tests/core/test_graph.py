import heapq
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import graph
from wayfold.operators.components import connected_components

EDGE = "id string, src string, dst string, cost double, risk double, requires array<string>, routeable boolean, condition_unknown array<string>"


def dijkstra(edges, seeds, weight):
    dist, heap = {s: 0 for s in seeds}, [(0, s) for s in seeds]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for e in edges:
            if e[1] == u and d + weight(e) < dist.get(e[2], float("inf")):
                dist[e[2]] = d + weight(e)
                heapq.heappush(heap, (dist[e[2]], e[2]))
    return dist


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_same_as_dijkstra_with_hubs(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(30)]
    rows = [(f"e{i}", r.choice(names), r.choice(names), float(r.randint(1, 9)), float(r.randint(0, 3)), [], None, []) for i in range(70)]
    df = spark.createDataFrame(rows, EDGE)
    hubs = names[::7]
    got = {x.node: x.dist for x in graph.cheapest(df, spark.createDataFrame([("n0",)], "node string"), graph.edge_weight(df, 0), hubs=spark.createDataFrame([(h,) for h in hubs], "node string"), hub_cost=1.0).collect()}
    full = rows + [("h", a, b, 1.0, 0.0, [], None, []) for a in hubs for b in hubs if a != b]
    assert got == dijkstra(full, ["n0"], lambda e: e[3] + 2 * e[4])
    with pytest.raises(ValueError):
        graph.cheapest(df, spark.createDataFrame([("n0",)], "node string"), F.col("cost") - 5)


def tables(spark, edges, conditions=()):
    nodes = spark.createDataFrame([(n, n, i, n in ("a", "d")) for i, n in enumerate("abcdef")], "id string, label string, seq int, is_grace_anchor boolean")
    return nodes, spark.createDataFrame(edges, EDGE), spark.createDataFrame([(c,) for c in conditions], "id string")


def test_route_semantics(spark):
    nan = float("nan")
    nodes, edges, _ = tables(spark, [
        ("e1", "a", "b", 1.0, None, ["key"], None, []), ("e2", "b", "c", None, 1.0, [], None, []), ("e3", "a", "c", 9.0, 0.0, None, True, None),
        ("e4", "a", "c", 0.1, 0.0, [], False, []), ("e5", "a", "c", nan, 0.0, [], None, []), ("e6", "a", "c", 0.1, 0.0, [], None, ["?"])])
    one = lambda *a, **k: graph.route(nodes, edges, *a, **k).first()
    assert one("a", "c").score == 9.0 and one("a", "c", ["key"]).score == 4.0
    assert one("a", "c", ["key"]).nodes == ["a", "b", "c"] and one("a", "c", ["key"]).time == 2.0 and one("a", "c", ["key"]).risk == 1.0
    assert one("a", "c", [], 2.0, False, None, False).score == 0.1 and one("a", "a").score == 0.0
    assert one("a", "e") is None and one("a", "zz") is None
    fast = one("a", "d", ["rule"], fast_travel=True, rule="rule")
    assert fast.score == 1.0 and one("a", "d", [], fast_travel=True, rule="rule") is None
    assert graph.numbered_text(graph.route(nodes, edges, "a", "c", ["key"]).withColumn("k", F.lit(1)), "k", nodes.limit(0).select("id", F.col("id").alias("label"))).first().text == "1. a -> b\n2. b -> c"


def test_explanations(spark):
    nodes, edges, conditions = tables(spark, [("e1", "a", "b", 1.0, 0.0, ["k1", "k2"], None, []), ("e2", "b", "c", 1.0, 0.0, ["undefined"], None, []), ("e3", "d", "c", 1.0, 0.0, [], None, [])], ["k1", "k2"])
    say = lambda *a: sorted((r.category, r.condition, r.defined) for r in graph.explain_blocked(nodes, edges, conditions, *a).collect())
    assert say("a", "a") == [("same-node", None, None)] and say("x", "a") == [("missing-origin", None, None)] and say("a", "x") == [("missing-destination", None, None)]
    assert say("a", "f") == [("cross-component", None, None)] and say("a", "d") == [("no-route", None, None)]
    assert say("a", "c", ["k1"]) == [("conditions", "k2", True), ("conditions", "undefined", False)] and say("a", "b", ["k1", "k2"]) == [("ok", None, None)]
    assert graph.explain_blocked(nodes.limit(0), edges, conditions, "a", "b").first().category == "no-data"


def test_components_chain_and_star(spark):
    rows = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (5000, 5000), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1100)) and got[5000] == 5000
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
