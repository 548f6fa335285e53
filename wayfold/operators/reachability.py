"""An index that answers whether one node reaches another by a join of labels.

Strongly connected components are found by colouring: the first node that reaches each is spread
forwards and the first that it reaches backwards, in the same rounds. Where the two are one, it lies in
the node's component; the others are coloured again within equal pairs. Components then are the
nodes of an acyclic graph, whose labels are pruned landmarks:
node v is labelled with landmark w if w reaches v and no node of a higher place lies on the way. For
every pair that is connected, the highest node on any of its paths is a label of both, so a query
joins two short lists instead of searching. Rounds grow with the graph's diameter, a quarter of it where nodes have
few edges; a round holds labels that are new, not a closure for each seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.relational import numbered
from wayfold.storage import discard, materialize


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").dropna().filter("src <> dst").distinct()


def _inner(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out: no other can lie on a cycle."""
    both = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_semi").distinct()
    out = edges.join(both, edges["src"] == both["node"], "left_semi")
    return out.join(both, out["dst"] == both["node"], "left_semi")


def _shortened(edges: DataFrame, width: int = 8) -> DataFrame:
    """(src, dst, low), written: the edges and ways of up to four edges, so that rounds are a quarter of a path's length.

    low is the least node on a way, its ends included; of several ways between two nodes the one with the
    greatest is kept. Ways are joined only at nodes with at most `width` of them in or out, so a join makes
    no more than 2 * width for each there is; where none is made, the edges lead on.
    """
    ways = materialize(edges.select("src", "dst", F.least("src", "dst").alias("low")), "ways")
    for _ in range(2):
        ends = ways.select(F.col("dst").alias("at"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(ways.select("src", F.lit(0), F.lit(1)))
        narrow = ends.groupBy("at").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).filter(f"least(i, o) between 1 and {width}").select("at")
        a = ways.select("src", F.col("dst").alias("at"), F.col("low").alias("_low")).join(narrow, "at", "left_semi")
        longer = a.join(ways.select(F.col("src").alias("at"), "dst", "low"), "at").filter("src <> dst").select("src", "dst", F.least("low", "_low").alias("low"))
        fresh = materialize(ways.union(longer).groupBy("src", "dst").agg(F.max("low").alias("low")), "ways")
        discard(ways)
        ways = fresh
    return ways


def _both_ways(ways: DataFrame) -> DataFrame:
    """(side, at, to, low): ways forwards as `in`, backwards as `out`."""
    way = F.explode(F.array(F.struct(F.lit("in").alias("side"), F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.lit("out").alias("side"), F.col("dst").alias("at"), F.col("src").alias("to"))))
    return ways.select(way.alias("w"), "low").select("w.*", "low")


def _colours(ways: DataFrame, max_rounds: int) -> DataFrame:
    """(node, f, b), written: the first among a node and all that reach it, and among it and all that it reaches.

    Nodes with many ways in and out come first: they lie in large components, which then have one colour at once.
    """
    both = materialize(_both_ways(ways).drop("low"), "both")
    degree = both.groupBy(F.col("to").alias("node")).agg(F.sum(F.when(F.col("side") == "in", -1).otherwise(0)).alias("i"), F.sum(F.when(F.col("side") == "out", 1).otherwise(0)).alias("o"))
    first = degree.select(F.explode(F.array(F.lit("in"), F.lit("out"))).alias("side"), "node", F.struct((F.col("i") * F.col("o")).alias("d"), F.col("node").alias("id")).alias("c"))
    state = materialize(first.withColumn("new", F.lit(True)), "colours")
    for _ in range(max_rounds):
        front = state.filter("new").select("side", F.col("node").alias("at"), "c")
        if front.isEmpty():
            kept = [F.min(F.when(F.col("side") == side, F.col("c"))) for side in ("in", "out")]
            out = materialize(state.groupBy("node").agg(kept[0].alias("f"), kept[1].alias("b")).select("node", F.col("f.id").alias("f"), F.col("b.id").alias("b")), "colours")
            discard(state, both)
            return out
        told = front.join(both, ["side", "at"]).select("side", F.col("to").alias("node"), "c", F.lit(None).cast(front.schema["c"].dataType).alias("was"))
        least = state.select("side", "node", "c", F.col("c").alias("was")).union(told).groupBy("side", "node").agg(F.min("c").alias("c"), F.min("was").alias("was"))
        fresh = materialize(least.select("side", "node", "c", (F.col("c") < F.col("was")).alias("new")), "colours")
        discard(state)
        state = fresh
    raise RuntimeError("colours did not settle")


def scc_labels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, scc) of every endpoint: its strongly connected component, named by the least id in it.

    Null endpoints are dropped, repeated edges count once, a node on no cycle is a component of its
    own; an empty list gives an empty result.
    """
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).dropna().distinct()
    inner, found = materialize(_inner(_edges(edges)), "cyclic"), None
    left = inner if inner.isEmpty() else _shortened(inner)
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        colours = _colours(left, max_rounds)
        members = colours.filter("f = b").select("node", F.col("f").alias("c"))
        found = members if found is None else found.union(members)
        # the others' components lie within one pair of colours, as does every way whose ends have that pair
        a, b = (colours.filter("f <> b").select(F.col("node").alias(e), "f", "b") for e in ("src", "dst"))
        rest = materialize(left.join(a, "src").join(b, ["dst", "f", "b"]).select("src", "dst", "low"), "cyclic")
        fresh = materialize(_inner(rest), "cyclic")
        discard(left, rest)
        left = fresh
    else:
        raise RuntimeError("components did not settle")
    discard(inner, left)
    if found is None:
        return ids.select("id", F.col("id").alias("scc"))
    least = materialize(found.groupBy("c").agg(F.min("node").alias("scc")), "least")
    return ids.join(found.join(least, "c").select(F.col("node").alias("id"), "scc"), "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def condensed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst): the acyclic graph of the components of scc_labels(), without repeated edges."""
    a, b = (labels.select(F.col("id").alias(e), F.col("scc").alias(f"_{e}")) for e in ("src", "dst"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").filter("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


@dataclass(frozen=True)
class ReachIndex:
    """places (id, place): each node's component by its place in the order of landmarks, 1 the highest.

    labels (side, landmark, node), in places: `in` says that the landmark reaches the node, `out`
    that the node reaches the landmark; every node is a landmark of its own.
    """

    places: DataFrame
    labels: DataFrame

    def save(self, path: str) -> None:
        self.places.write.mode("errorifexists").parquet(f"{path}/places")
        self.labels.write.mode("errorifexists").partitionBy("side").parquet(f"{path}/labels")


def load_index(spark: SparkSession, path: str) -> ReachIndex:
    return ReachIndex(spark.read.parquet(f"{path}/places"), spark.read.parquet(f"{path}/labels").select("side", "landmark", "node"))


def _covered(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """Of asked (side, landmark, node), those that labels of other landmarks answer already."""
    other = F.when(F.col("side") == "in", "out").otherwise("in")
    via = labels.select(other.alias("side"), F.col("node").alias("landmark"), F.col("landmark").alias("via"))
    met = asked.join(via, ["side", "landmark"])
    known = labels.select("side", F.col("landmark").alias("via"), "node")
    return met.join(known, ["side", "via", "node"], "left_semi").select("side", "landmark", "node").distinct()


def _labels(ways: DataFrame, starts: DataFrame, known: DataFrame | None, max_rounds: int) -> DataFrame:
    """Labels (side, landmark, node) of the starts (place): each spreads over lower nodes only (low is a way's highest place), and not where known labels answer."""
    sides = F.explode(F.array(F.lit("in"), F.lit("out")))
    seen = front = materialize(starts.select(sides.alias("side"), F.col("place").alias("landmark"), F.col("place").alias("node")), "labels")
    for k in range(1, max_rounds + 1):
        new = front.withColumnRenamed("node", "at").join(ways, ["side", "at"]).filter("low >= landmark").select("side", "landmark", F.col("to").alias("node")).distinct()
        new = new.join(seen, ["side", "landmark", "node"], "left_anti")
        if known is not None:
            new = materialize(new, "asked")
            new = new.join(_covered(new, known), ["side", "landmark", "node"], "left_anti")
        front = materialize(new, "labels")
        if front.isEmpty():
            return seen
        seen = seen.union(front) if k % 8 else materialize(seen.union(front), "labels")
    raise RuntimeError("labels did not settle")


def reach_index(edges: DataFrame, first: int = 64, max_rounds: int = 10_000) -> ReachIndex:
    """The index of a directed graph (src, dst); see scc_labels() for its rows.

    Landmarks are placed by (edges in + 1) * (edges out + 1) of their component. The `first` highest are
    spread before the others, which then stop wherever these answer; the number only saves work.
    """
    edges = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    labels = materialize(scc_labels(edges, max_rounds), "scc")
    dag = materialize(condensed(edges, labels), "dag")
    ends = dag.select(F.col("src").alias("scc"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(dag.select("dst", F.lit(0), F.lit(1)))
    degree = ends.groupBy("scc").agg(((F.sum("o") + 1) * (F.sum("i") + 1)).alias("d"))
    every = labels.select("scc").distinct().join(degree, "scc", "left").withColumn("d", F.coalesce("d", F.lit(1)))
    placed = materialize(numbered(every, [F.desc("d"), F.asc("scc")], "place").select("scc", F.col("place").cast("long").alias("place")), "places")
    a, b = (placed.select(F.col("scc").alias(e), F.col("place").alias(f"_{e}")) for e in ("src", "dst"))
    ways = materialize(_both_ways(_shortened(dag.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))), "ways")
    high = materialize(_labels(ways, placed.filter(F.col("place") <= first), None, max_rounds), "labels")
    rest = _labels(ways, placed.filter(F.col("place") > first), high, max_rounds)
    places = materialize(labels.join(placed, "scc").select("id", "place"), "places")
    out = ReachIndex(places, materialize(high.union(rest), "labels"))
    discard(edges, labels, dag, placed, ways)
    return out


def reach_by_labels(index: ReachIndex, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with reaches boolean: whether a path leads from a to b. A node reaches itself, known or not; a null reaches nothing."""
    asked = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).dropna().distinct()
    x, y = (index.places.select(F.col("id").alias(c), F.col("place").alias(f"_p{c}")) for c in ("_a", "_b"))
    placed = materialize(asked.join(x, "_a", "left").join(y, "_b", "left"), "pairs")
    same = placed.filter("_a = _b or _p_a = _p_b").select("_a", "_b")
    far = placed.filter("_a <> _b and _p_a <> _p_b")
    out = index.labels.filter("side = 'out'").select(F.col("node").alias("_p_a"), "landmark")
    into = index.labels.filter("side = 'in'").select(F.col("node").alias("_p_b"), "landmark")
    met = far.join(out, "_p_a").join(into, ["_p_b", "landmark"], "left_semi").select("_a", "_b").distinct()
    hit = same.union(met).withColumn("_hit", F.lit(True))
    return pairs.join(hit, (pairs[a] == hit["_a"]) & (pairs[b] == hit["_b"]), "left").withColumn("reaches", F.coalesce("_hit", F.lit(False))).drop("_a", "_b", "_hit")
