"""Conditional directed multigraph operators as frontier loops over DataFrames.

Edges are rows (id, src, dst, cost, risk, requires, routeable, condition_unknown); columns that a
table lacks count as absent values. A round is one join of the frontier with the edges and one
aggregation; state is written to the shared folder each round, so lineage stays one scan long and a
lost executor costs one round. Loops stop when a round changes nothing and raise if max_rounds
does not suffice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.components import connected_components
from wayfold.operators.relational import numbered
from wayfold.storage import discard, materialize

#: Presets of the risk weight.
RISK_WEIGHTS = {"fast": 0.35, "balanced": 2.0, "safe": 5.5}


def _col(edges: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in edges.columns else F.lit(None).cast(kind)


def missing_conditions(edges: DataFrame, active: Sequence[str]) -> Column:
    """The required conditions of an edge that are not active."""
    known = F.array(*[F.lit(c) for c in active]).cast("array<string>")
    return F.array_except(F.coalesce(_col(edges, "requires", "array<string>"), F.array().cast("array<string>")), known)


def usable_edges(edges: DataFrame, active: Sequence[str] | None = None, check_unknown: bool = True) -> DataFrame:
    """Edges that a route may take: routeable is not false, no unknown condition, all required conditions active.

    active None grants every condition. A null routeable or requires does not exclude an edge.
    """
    out = edges.filter(F.coalesce(_col(edges, "routeable", "boolean"), F.lit(True)))
    if check_unknown:
        unknown = _col(edges, "condition_unknown", "array<string>")
        out = out.filter(F.coalesce(F.size(unknown), F.lit(0)) <= 0)
    if active is not None:
        out = out.filter(F.size(missing_conditions(edges, active)) == 0)
    return out


def edge_weight(edges: DataFrame, risk_weight: float | None = None) -> Column:
    """cost + risk * weight; a weight of 0 or None counts as 2.0, an absent cost as 1, an absent risk as 0."""
    cost = F.coalesce(_col(edges, "cost", "double"), F.lit(1))
    return cost + F.coalesce(_col(edges, "risk", "double"), F.lit(0)) * F.lit(risk_weight or 2.0)


def _checked(ways: DataFrame, weights: Sequence[str]) -> DataFrame:
    """ways, written, without rows whose weight is null or NaN; negative weights raise."""
    for n in weights:
        ways = ways.filter(F.col(n).isNotNull() & (~F.isnan(F.col(n).cast("double"))))
    ways = materialize(ways, "ways")
    if not ways.filter(" or ".join(f"{n} < 0" for n in weights)).isEmpty():
        raise ValueError("negative weights")
    return ways


def cheapest(edges: DataFrame, seeds: DataFrame, weight: Column | Sequence[Column], hubs: DataFrame | None = None,
             hub_cost=1, target=None, max_rounds: int = 10_000) -> DataFrame:
    """(node, dist, hops, via, prev) of the cheapest path from any seed (node) to every node it reaches.

    weight: a number column over edges (src, dst, id), or several, which are compared one after the
    other; dist is then a struct w0, w1 ... Rows whose weight is null or NaN are never taken; negative weights
    raise. Ties go to fewer hops, then the least edge id. hubs (node) are linked with each other
    at hub_cost: a round carries the least hub distance over to all hubs, which equals all their
    mutual edges (for one weight only). With target the loop ends once no open node is nearer than it.
    """
    parts = [weight] if isinstance(weight, Column) else list(weight)
    names = [f"w{i}" for i in range(len(parts))]
    ways = edges.select("src", "dst", _col(edges, "id", "string").cast("string").alias("via"), *[w.alias(n) for w, n in zip(parts, names, strict=True)])
    ways = _checked(ways, names)
    kinds = dict(ways.dtypes)
    dist = F.struct(*[F.lit(0).cast(kinds[n]).alias(n) for n in names])
    start = F.struct(dist.alias("d"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("prev"))
    state = materialize(seeds.select("node").distinct().select("node", start.alias("b"), F.lit(True).alias("new")), "state")
    front = state
    for _ in range(max_rounds):
        far = F.struct(*[(F.col("b.d")[n] + F.col(n)).alias(n) for n in names])
        near = front.select("node", "b").join(ways, front["node"] == ways["src"])
        tried = near.select(F.col("dst").alias("node"), F.struct(far.alias("d"), (F.col("b.hops") + 1).alias("hops"), "via", F.col("src").alias("prev")).alias("b"))
        if hubs is not None:
            least = front.join(hubs.select("node"), "node", "left_semi").agg(F.min(F.struct("b.d", "b.hops", "node")).alias("m")).first()["m"]
            if least is not None:
                jump = F.struct((F.lit(least["d"][names[0]]) + F.lit(hub_cost)).cast(kinds[names[0]]).alias(names[0]))
                tried = tried.union(hubs.select("node").distinct().filter(F.col("node") != F.lit(least["node"])).select(
                    "node", F.struct(jump.alias("d"), F.lit(least["hops"] + 1).alias("hops"), F.lit("hub").alias("via"), F.lit(least["node"]).alias("prev")).alias("b")))
        # old and tried rows meet in one aggregation; a node is new if nothing was known or the distance fell
        every = state.select("node", "b", F.col("b.d").alias("old")).unionByName(tried, allowMissingColumns=True)
        best = every.groupBy("node").agg(F.min("b").alias("b"), F.min("old").alias("old"))
        changed = F.col("old").isNull() | (F.col("b.d") < F.col("old"))
        fresh = materialize(best.select("node", "b", changed.alias("new")), "state")
        discard(state)
        state, front = fresh, fresh.filter("new")
        if target is not None:
            goal = state.filter(F.col("node") == F.lit(target)).select("b.d").first()
            if goal is not None:
                limit = F.struct(*[F.lit(goal["d"][n]).cast(kinds[n]).alias(n) for n in names])
                front = front.filter(F.col("b.d") < limit)
        if front.isEmpty():
            break
    else:
        raise RuntimeError("paths did not settle")
    state = state.select("node", "b.*")
    shown = F.col("d")[names[0]] if len(names) == 1 else F.col("d")
    return state.select("node", shown.alias("dist"), "hops", "via", "prev")


def _with_each(left: DataFrame, right: DataFrame, buckets: int = 64) -> DataFrame:
    """Each row of left with each of right's (one column), where the result is that product: dealt by buckets of right's rows."""
    spread = left.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return spread.join(right.withColumn("_k", F.pmod(F.xxhash64(right.columns[0]), F.lit(buckets)).cast("int")), "_k").drop("_k")


def anchor_pairs(anchors: DataFrame) -> DataFrame:
    """(src, dst): the explicit fast-travel edges between all anchors (node); routing needs none of them, see cheapest()."""
    a = anchors.select("node").distinct()
    return _with_each(a.select(F.col("node").alias("src")), a.select(F.col("node").alias("dst"))).filter("src <> dst")


def reach(edges: DataFrame, seeds: DataFrame, hubs: DataFrame | None = None, levels: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(seed, node, level): what each seed group (seed, node) reaches, and in how many edges.

    A seed reaches its own nodes at level 0. hubs (node): who reaches one reaches all at the next
    level. levels bounds the depth; without it the loop runs until nothing new is reached.
    """
    ways = materialize(edges.select("src", "dst").distinct(), "ways")
    seen = materialize(seeds.select("seed", "node").distinct().withColumn("level", F.lit(0)), "seen")
    front = seen
    for k in range(1, (max_rounds if levels is None else levels) + 1):
        new = front.join(ways, front["node"] == ways["src"]).select("seed", F.col("dst").alias("node"))
        if hubs is not None:
            at_hub = front.join(hubs.select("node"), "node", "left_semi").select("seed").distinct()
            new = new.union(_with_each(at_hub, hubs.select("node").distinct()))
        new = materialize(new.distinct().join(seen, ["seed", "node"], "left_anti").withColumn("level", F.lit(k)), "front")
        if new.isEmpty():
            return seen
        # levels stay in their own files; now and then they are written as one table to keep plans short
        seen, front = seen.union(new), new
        if k % 8 == 0:
            seen = materialize(seen, "seen")
    if levels is None:
        raise RuntimeError("closure did not settle")
    return seen


def path_rows(state: DataFrame, target) -> list:
    """The rows (node, via, prev, hops) of cheapest() on the way to target, from the seed on; none if it was not reached.

    Predecessors are followed by pointer doubling: a round doubles the length that is known, so a
    path of n edges takes log2(n) rounds. Only the path's own rows come to the driver.
    """
    state = state.select("node", "via", "prev", "hops")
    goal = state.filter(F.col("node") == F.lit(target)).select("hops").first()
    if goal is None:
        return []
    marks = state.filter(F.col("node") == F.lit(target)).select("node")
    jump, span = state.filter("prev is not null").select("node", F.col("prev").alias("to")), 1
    while span <= goal["hops"]:
        marks = materialize(marks.union(marks.join(jump, "node").select(F.col("to").alias("node"))).distinct(), "marks")
        span *= 2
        if span <= goal["hops"]:
            jump = materialize(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")), "jump")
    return state.join(marks, "node", "left_semi").orderBy("hops").collect()


def route(nodes: DataFrame, edges: DataFrame, origin, target, active: Sequence[str] = (), risk_weight: float | None = None,
          fast_travel: bool = False, rule: str | None = None, check_unknown: bool = True) -> DataFrame:
    """One row (nodes, edges, score, time, risk) with the cheapest route, or none.

    No row if an endpoint is no node or no route is open; a route from a node to itself is empty
    with score 0. Fast travel between anchors (nodes.is_grace_anchor) costs 1 and needs rule in active.
    """
    spark = nodes.sparkSession
    kind, step = dict(nodes.dtypes)["id"], "array<struct<id:string,src:{0},dst:{0},cost:double,risk:double>>"
    step = step.format(kind)
    shape = f"nodes array<{kind}>, edges {step}, score double, time double, risk double"
    if nodes.filter(F.col("id").isin(origin, target)).select("id").distinct().count() < (1 if origin == target else 2):
        return spark.createDataFrame([], shape)
    if origin == target:
        return spark.createDataFrame([([origin], [], 0.0, 0.0, 0.0)], shape)
    open_ = usable_edges(edges, active, check_unknown)
    hubs = nodes.filter("is_grace_anchor").select(F.col("id").alias("node")) if fast_travel and rule in active else None
    seed = spark.createDataFrame([(origin,)], f"node {kind}")
    state = materialize(cheapest(open_, seed, edge_weight(open_, risk_weight).cast("double"), hubs, target=target), "state")
    rows = path_rows(state, target)
    if not rows:
        return spark.createDataFrame([], shape)
    score = state.filter(F.col("node") == F.lit(target)).first()["dist"]
    path, taken = [r["node"] for r in rows], [(r["via"], r["prev"], r["node"]) for r in rows[1:]]
    ids = [e for e, _, _ in taken if e != "hub"]
    kinds = {r["id"]: (r["cost"], r["risk"]) for r in edges.filter(F.col("id").isin(ids)).select(
        F.col("id").cast("string").alias("id"), F.coalesce(_col(edges, "cost", "double"), F.lit(1)).cast("double").alias("cost"),
        F.coalesce(_col(edges, "risk", "double"), F.lit(0)).cast("double").alias("risk")).collect()} if ids else {}
    legs = [(e, a, b, *(kinds[e] if e != "hub" else (1.0, 0.0))) for e, a, b in taken]
    return spark.createDataFrame([(path, legs, float(score), sum(x[3] for x in legs), sum(x[4] for x in legs))], shape)


def numbered_text(found: DataFrame, key: str, labels: DataFrame, notes: DataFrame | None = None, heading: str | None = None, one_way_mark: str = "", arrow: str = " -> ") -> DataFrame:
    """(key, text): routes (key, edges array of id, src, dst) as numbered lines `1. A -> B`, a route without edges as its heading only.

    labels: id, label; a node without one is shown by its id. notes: id, one_way, mode of edges; a
    one-way edge gets the mark, and a mode is added after ` · `. heading may hold {} for the number of edges.
    """
    legs = found.select(key, F.posexplode("edges").alias("pos", "e")).select(key, "pos", F.col("e.id").cast("string").alias("id"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
    for end in ("src", "dst"):
        legs = legs.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"_{end}")).dropDuplicates([end]), end, "left")
    shown = lambda end: F.coalesce(f"_{end}", F.col(end).cast("string"), F.lit("?"))
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), shown("src"), F.lit(arrow), shown("dst"))
    if notes is not None:
        side = notes.select(F.col("id").cast("string").alias("id"), F.col("one_way").alias("_one"), F.col("mode").alias("_mode")).dropDuplicates(["id"])
        legs = legs.join(side, "id", "left")
        line = F.concat(line, F.when(F.col("_one"), one_way_mark).otherwise(""), F.when(F.col("_mode").isNotNull(), F.concat(F.lit(" · "), F.col("_mode"))).otherwise(""))
    text = legs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("_text"))
    out = found.select(key, F.size("edges").alias("_n")).join(text, key, "left")
    head = [] if heading is None else [F.replace(F.lit(heading), F.lit("{}"), F.greatest("_n", F.lit(0)).cast("string"))]
    return out.select(key, F.concat_ws("\n", *head, F.col("_text")).alias("text"))


def blocker_costs(edges: DataFrame, seeds: DataFrame, active: Sequence[str] = (), missing: str | None = None) -> DataFrame:
    """(node, missing, cost, hops, via, prev): least number of missing conditions, then least cost.

    missing names an array column of each edge's missing conditions, which else are those not in
    active. A cost of 0 counts as 1 here, as an absent one does; risk and unknown conditions do not count.
    """
    open_ = usable_edges(edges, None, check_unknown=False)
    cost = F.coalesce(_col(open_, "cost", "double"), F.lit(1))
    lacks = missing_conditions(open_, active) if missing is None else F.col(missing)
    got = cheapest(open_, seeds, [F.size(lacks).cast("long"), F.when(cost == 0, F.lit(1)).otherwise(cost)])
    return got.select("node", F.col("dist.w0").alias("missing"), F.col("dist.w1").alias("cost"), "hops", "via", "prev")


def explain_blocked(nodes: DataFrame, edges: DataFrame, conditions: DataFrame, origin, target, active: Sequence[str] = (), risk_weight: float | None = None) -> DataFrame:
    """(category, condition, defined): why there is no route.

    category is no-data, missing-origin, missing-destination, same-node, ok, cross-component,
    no-route or conditions; for conditions there is a row for each condition that the cheapest path
    under all defined conditions needs and that is not active.
    """
    spark = nodes.sparkSession
    shape = "category string, condition string, defined boolean"
    known = {r["id"] for r in nodes.filter(F.col("id").isin(origin, target)).select("id").distinct().collect()}
    say = None
    if nodes.isEmpty():
        say = "no-data"
    elif origin not in known:
        say = "missing-origin"
    elif target not in known:
        say = "missing-destination"
    elif origin == target:
        say = "same-node"
    elif not route(nodes, edges, origin, target, active, risk_weight).isEmpty():
        say = "ok"
    if say is None:
        both = components(nodes, usable_edges(edges, None, check_unknown=False)).filter(F.col("id").isin(origin, target)).select("component").distinct().count()
        say = "cross-component" if both > 1 else None
    if say is not None:
        return spark.createDataFrame([(say, None, None)], shape)
    kind = dict(nodes.dtypes)["id"]
    granted = unknown_conditions(edges, conditions).withColumn("_missing", F.col("condition_unknown"))
    state = materialize(blocker_costs(granted, spark.createDataFrame([(origin,)], f"node {kind}"), missing="_missing"), "state")
    taken = [r["via"] for r in path_rows(state, target)[1:]]
    if not taken:
        return spark.createDataFrame([("no-route", None, None)], shape)
    needs = edges.filter(F.col("id").cast("string").isin(taken)).select(F.explode(F.array_distinct(F.concat(
        missing_conditions(edges, active), F.coalesce(_col(edges, "condition_unknown", "array<string>"), F.array().cast("array<string>"))))).alias("condition")).distinct()
    known = conditions.select(F.col("id").alias("condition")).distinct().withColumn("defined", F.lit(True))
    return needs.join(known, "condition", "left").select(F.lit("conditions").alias("category"), "condition", F.coalesce("defined", F.lit(False)).alias("defined"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every node; nodes without an edge are components of their own."""
    linked = connected_components(edges.select("src", "dst"))
    return nodes.select("id").distinct().join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_stats(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, ordinal, node_count, grace_count, regions, sample), the largest first.

    nodes has id, seq, region, is_grace_anchor. Ordinals follow the components' first nodes; at most 12 regions are named.
    """
    grouped = nodes.join(labels, "id").groupBy("component").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("node_count"), F.count_if("is_grace_anchor").alias("grace_count"),
        F.slice(F.array_sort(F.collect_set("region")), 1, 12).alias("regions"), F.min_by("id", "seq").alias("sample"))
    ranked = numbered(grouped, [F.asc("first_seq"), F.asc("component")], "ordinal").withColumn("ordinal", (F.col("ordinal") - 1).cast("int"))
    return ranked.orderBy(F.desc("node_count"), "first_seq").drop("first_seq")


def nearest_anchor(edges: DataFrame, anchors: DataFrame, weight: Column, max_rounds: int = 10_000) -> DataFrame:
    """(node, anchor, dist): for each node the anchor (node) from which it is cheapest to come, ties to the least.

    One pass from all anchors: the anchor travels along with the distance. Rows whose weight is null
    or NaN are never taken; negative weights raise.
    """
    ways = _checked(edges.select("src", "dst", weight.alias("w")), ["w"])
    start = F.struct(F.lit(0).cast(dict(ways.dtypes)["w"]).alias("dist"), F.col("node").alias("anchor"))
    state = materialize(anchors.select("node").distinct().select("node", start.alias("b"), F.lit(True).alias("new")), "state")
    for _ in range(max_rounds):
        front = state.filter("new")
        if front.isEmpty():
            return state.select("node", F.col("b.anchor").alias("anchor"), F.col("b.dist").alias("dist"))
        tried = front.join(ways, front["node"] == ways["src"]).select(F.col("dst").alias("node"), F.struct((F.col("b.dist") + F.col("w")).alias("dist"), F.col("b.anchor").alias("anchor")).alias("b"))
        every = state.select("node", "b", F.col("b").alias("old")).unionByName(tried, allowMissingColumns=True)
        best = every.groupBy("node").agg(F.min("b").alias("b"), F.min("old").alias("old"))
        fresh = materialize(best.select("node", "b", (F.col("old").isNull() | (F.col("b") < F.col("old"))).alias("new")), "state")
        discard(state)
        state = fresh
    raise RuntimeError("paths did not settle")


def blocked_frontier(edges: DataFrame, origin: DataFrame, active: Sequence[str]) -> DataFrame:
    """(condition, n_edges): what is missing on the edges that leave the reachable set."""
    seen = reach(usable_edges(edges, active), origin.select(F.lit(0).alias("seed"), "node")).select("node")
    leaving = edges.join(seen, edges["src"] == seen["node"], "left_semi").join(seen, edges["dst"] == seen["node"], "left_anti")
    return leaving.select(F.explode(missing_conditions(leaving, active)).alias("condition")).groupBy("condition").agg(F.count("*").alias("n_edges"))


def focus_set(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node): the chosen nodes and their neighbours in either direction."""
    out = edges.join(chosen, edges["src"] == chosen["node"], "left_semi").select(F.col("dst").alias("node"))
    back = edges.join(chosen, edges["dst"] == chosen["node"], "left_semi").select(F.col("src").alias("node"))
    return chosen.select("node").union(out).union(back).distinct()


def region_gaps(nodes: DataFrame, edges: DataFrame, declared: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """declared pairs (src_region, dst_region, any others) without a path between their nodes.

    The search runs from all regions at once; a region is followed no further once all its declared
    pairs are found, so only what stays open is searched to its end.
    """
    ways, of = materialize(edges.select("src", "dst").distinct(), "ways"), nodes.select(F.col("id").alias("node"), "region")
    left = materialize(declared, "declared")
    seen = materialize(of.join(left.select(F.col("src_region").alias("region")).distinct(), "region", "left_semi").select(F.col("region").alias("seed"), "node"), "seen")
    front = seen
    for k in range(1, max_rounds + 1):
        met = front.join(of, "node").select(F.col("seed").alias("src_region"), F.col("region").alias("dst_region")).distinct()
        left = materialize(left.join(met, ["src_region", "dst_region"], "left_anti"), "declared")
        live = front.join(left.select(F.col("src_region").alias("seed")).distinct(), "seed", "left_semi")
        new = live.join(ways, live["node"] == ways["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = materialize(new.join(seen, ["seed", "node"], "left_anti"), "front")
        if front.isEmpty():
            return left
        seen = seen.union(front) if k % 8 else materialize(seen.union(front), "seen")
    raise RuntimeError("gaps did not settle")


def anchors_of_regions(nodes: DataFrame, kind_rank: Sequence[str]) -> DataFrame:
    """(region, anchor): the region's first node of the earliest listed kind (nodes: id, region, kind, seq)."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kind_rank]), F.col("kind")), F.lit(0))
    rank = F.when(rank == 0, len(kind_rank) + 1).otherwise(rank)
    return nodes.groupBy("region").agg(F.min_by("id", F.struct(rank, "seq")).alias("anchor"))


def close_gaps(gaps: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, src, dst, cost, risk, mode): a bridge edge between the anchors of each gap's regions."""
    a = anchors.select(F.col("region").alias("src_region"), F.col("anchor").alias("src"))
    b = anchors.select(F.col("region").alias("dst_region"), F.col("anchor").alias("dst"))
    made = gaps.join(a, "src_region").join(b, "dst_region").select("src_region", "dst_region", "src", "dst")
    return made.select(F.concat_ws(":", F.lit("bridge"), "src_region", "dst_region").alias("id"), "src", "dst", F.lit(1.0).alias("cost"), F.lit(0.0).alias("risk"), F.lit("bridge").alias("mode"))


def add_known(edges: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges and those known ones whose endpoints exist and whose id is new."""
    ids = nodes.select("id")
    fresh = known.join(ids, known["src"] == ids["id"], "left_semi").join(ids, known["dst"] == ids["id"], "left_semi").join(edges.select("id"), "id", "left_anti")
    return edges.unionByName(fresh, allowMissingColumns=True)


def attach_orphans(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges both ways between each node without an edge and its region's anchor."""
    used = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    alone = nodes.join(used, "id", "left_anti").join(anchors, "region").filter("id <> anchor").select("id", "anchor")
    ways = F.array(F.struct(F.col("id").alias("src"), F.col("anchor").alias("dst")), F.struct(F.col("anchor").alias("src"), F.col("id").alias("dst")))
    return alone.select(F.explode(ways).alias("e")).select(F.concat_ws(":", F.lit("orphan"), "e.src", "e.dst").alias("id"), "e.src", "e.dst", F.lit(1.0).alias("cost"), F.lit(0.0).alias("risk"))


def complete_nodes(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """nodes and the catalog's rows whose id no node has."""
    return nodes.unionByName(catalog.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


def partition(nodes: DataFrame, edges: DataFrame, bridge: str = "bridge") -> DataFrame:
    """edges with package_id: their nodes' package (nodes: id, package_id) if both agree, else the bridge."""
    p = nodes.select("id", "package_id")
    a, b = p.select(F.col("id").alias("src"), F.col("package_id").alias("_a")), p.select(F.col("id").alias("dst"), F.col("package_id").alias("_b"))
    both = edges.drop("package_id").join(a, "src", "left").join(b, "dst", "left")
    return both.withColumn("package_id", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.lit(bridge))).drop("_a", "_b")


def subgraph(nodes: DataFrame, edges: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that fulfil the condition, their incident edges, and the other nodes these refer to (external true)."""
    inner = nodes.filter(where)
    ids = inner.select("id")
    touch = edges.join(ids, (edges["src"] == ids["id"]), "left_semi").union(edges.join(ids, edges["dst"] == ids["id"], "left_semi")).distinct()
    named = touch.select(F.col("src").alias("id")).union(touch.select(F.col("dst").alias("id"))).distinct().join(ids, "id", "left_anti")
    outer = nodes.join(named, "id", "left_semi")
    return inner.withColumn("external", F.lit(False)).union(outer.withColumn("external", F.lit(True))), touch


def merge_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and a bare node for every endpoint that lacks one."""
    named = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.unionByName(named.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


def check_path(steps: DataFrame) -> DataFrame:
    """(path_id, n_steps, breaks, requires): declared paths' discontinuities and the union of their conditions.

    steps: path_id, pos, src, dst, requires. A break is a step that does not begin where the last ended.
    """
    from pyspark.sql.window import Window as W

    after = F.lead("src").over(W.partitionBy("path_id").orderBy("pos"))
    marked = steps.withColumn("_next", after)
    return marked.groupBy("path_id").agg(
        F.count("*").alias("n_steps"), F.count_if(F.col("_next") != F.col("dst")).alias("breaks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("requires")))).alias("requires"))


def direct_or_reverse(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with the match forward, reverse or none."""
    e = edges.select("src", "dst").distinct()
    fwd = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("_f"))
    rev = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("_r"))
    both = pairs.join(fwd, ["a", "b"], "left").join(rev, ["a", "b"], "left")
    return both.withColumn("match", F.when(F.col("_f") == 1, "forward").when(F.col("_r") == 1, "reverse").otherwise("none")).drop("_f", "_r")


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id): repeated node or edge ids and endpoints without a node; an intact graph gives no row."""
    twice = lambda df, rule: df.groupBy("id").count().filter("count > 1").select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("id"))
    out = twice(nodes, "repeated-node").union(twice(edges, "repeated-edge"))
    return out.union(dangling(nodes, edges).select(F.lit("dangling-edge"), F.col("id").cast("string")))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges one of whose endpoints is no node."""
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_anti").union(edges.join(ids, edges["dst"] == ids["id"], "left_anti")).distinct()


def unknown_conditions(edges: DataFrame, conditions: DataFrame) -> DataFrame:
    """edges with condition_unknown: their required conditions that no condition row defines."""
    needs = edges.select("id", F.explode("requires").alias("c"))
    bad = needs.join(conditions.select(F.col("id").alias("c")), "c", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("condition_unknown"))
    return edges.drop("condition_unknown").join(bad, "id", "left").withColumn("condition_unknown", F.coalesce("condition_unknown", F.array().cast("array<string>")))


def route_steps(legs: DataFrame, nodes: DataFrame, edges: DataFrame, active: Sequence[str]) -> DataFrame:
    """legs (pos, id, src, dst) with one_way, layer_change and missing: whether no edge leads back, the layers if they differ, and the conditions that are not active.

    nodes: id, layer; edges: id, src, dst, requires.
    """
    a, b = (nodes.select(F.col("id").alias(e), F.col("layer").alias(f"_{e}")) for e in ("src", "dst"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("_back", F.lit(True))
    lacks = edges.select("id", missing_conditions(edges, active).alias("missing")).dropDuplicates(["id"])
    out = legs.join(a, "src", "left").join(b, "dst", "left").join(back, ["src", "dst"], "left").join(lacks, "id", "left")
    change = F.when(~F.col("_src").eqNullSafe(F.col("_dst")), F.concat(F.coalesce("_src", F.lit("?")), F.lit(" -> "), F.coalesce("_dst", F.lit("?"))))
    return out.select("pos", "id", "src", "dst", F.col("_back").isNull().alias("one_way"), change.alias("layer_change"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def incident_edges(edges: DataFrame, node, active: Sequence[str]) -> DataFrame:
    """(direction, id, other, available): the edges of one node, and whether all their conditions are active."""
    ok = F.size(missing_conditions(edges, active)) == 0
    row = lambda way, other: F.struct(F.lit(way).alias("direction"), F.col("id"), F.col(other).alias("other"), ok.alias("available"))
    each = F.array_compact(F.array(F.when(F.col("src") == node, row("out", "dst")), F.when(F.col("dst") == node, row("in", "src"))))
    return edges.select(F.explode(each).alias("r")).select("r.*")


def edge_class(edges: DataFrame, active: Sequence[str], bridge: str = "bridge", route: Sequence[str] = (), focus: Sequence = ()) -> Column:
    """The class of a partitioned edge: route, blocked, unknown, conditional, focus, internal or external, the first that holds.

    route lists edge ids, focus nodes; package_id is that of partition().
    """
    unknown = F.coalesce(F.size(_col(edges, "condition_unknown", "array<string>")), F.lit(0)) > 0
    near = F.col("src").isin(list(focus)) | F.col("dst").isin(list(focus)) if focus else F.lit(False)
    taken = F.col("id").isin(list(route)) if route else F.lit(False)
    return (
        F.when(taken, "route").when(F.size(missing_conditions(edges, active)) > 0, "blocked").when(unknown, "unknown")
        .when(F.size("requires") > 0, "conditional").when(near, "focus").when(F.col("package_id") != bridge, "internal").otherwise("external")
    )
