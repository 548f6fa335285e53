"""Graphs of maps and their parts: building them from declarations, layers and endpoints, and cutting a map out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incident(table: DataFrame, ids: DataFrame, ends: Sequence[str] = ("src", "dst")) -> DataFrame:
    """Rows of a relation table one of whose ends is in ids (id), each row once."""
    known = ids.select("id").distinct()
    out, rest = None, table
    for e in ends:
        hit = rest.join(known, rest[e] == known["id"], "left_semi")
        rest = rest.join(known, rest[e] == known["id"], "left_anti")
        out = hit if out is None else out.union(hit)
    return out


def map_subgraph(nodes: DataFrame, edges: DataFrame, map_id: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None) -> dict[str, DataFrame]:
    """A map's subgraph: nodes (with external), edges, and each side table's rows that touch a node of the map.

    nodes: id, map_id. tables: name to (rows, columns that hold node ids). A map without nodes gives
    empty tables; whether that is an error is the caller's choice.
    """
    inner = nodes.filter(F.col("map_id") == map_id)
    out = {"edges": incident(edges, inner)}
    named = out["edges"].select(F.explode(F.array("src", "dst")).alias("id"))
    for name, (rows, ends) in (tables or {}).items():
        out[name] = incident(rows, inner, ends)
        named = named.union(out[name].select(F.explode(F.array(*ends)).alias("id")))
    outer = nodes.join(named.distinct(), "id", "left_semi").filter(~F.col("map_id").eqNullSafe(F.lit(map_id)))
    out["nodes"] = inner.withColumn("external", F.lit(False)).union(outer.withColumn("external", F.lit(True)))
    return out


def star(maps: DataFrame, links: DataFrame, map_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): the map, its links (src, dst) in both directions, and the maps at their other ends."""
    centre = maps.filter(F.col("id") == map_id)
    touch = links.filter((F.col("src") == map_id) | (F.col("dst") == map_id))
    others = touch.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return centre.union(maps.join(others, "id", "left_semi").filter(F.col("id") != map_id)), touch


def same_component(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with connected: whether both have one component (labels: id, component)."""
    a, b = (labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    got = pairs.join(a, "a", "left").join(b, "b", "left")
    return got.withColumn("connected", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def reaches(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with reachable: whether reach() found b from the seed a."""
    seen = closure.select(F.col("seed").alias("a"), F.col("node").alias("b")).distinct().withColumn("_s", F.lit(True))
    return pairs.join(seen, ["a", "b"], "left").withColumn("reachable", F.coalesce("_s", F.lit(False))).drop("_s")


def declared_graph(maps: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): maps (id) as nodes, and external ones (external true) for declared targets (src, dst, kind) that are no map; equal declarations count once with n."""
    ids = maps.select("id").distinct()
    known = declared.join(ids, declared["src"] == ids["id"], "left_semi")
    edges = known.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
    outer = edges.select(F.col("dst").alias("id")).distinct().join(ids, "id", "left_anti")
    return ids.withColumn("external", F.lit(False)).union(outer.withColumn("external", F.lit(True))), edges


def external_targets(missing: DataFrame, resolved: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Distinct keys of declared but missing targets, and of resolved ones that are not local."""
    return missing.select(key).union(resolved.select(key).join(local.select(key), key, "left_anti")).distinct()


def layered(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layers, members): a node for each (map_id, layer) of parts (id, map_id, layer) with its size, and the relation of each part to its layer."""
    has = parts.filter("layer is not null")
    layer = F.concat_ws(":", F.lit("layer"), "map_id", "layer")
    layers = has.groupBy(layer.alias("id"), "map_id", "layer").agg(F.count("*").alias("n_parts"))
    return layers, has.select(F.col("id").alias("src"), layer.alias("dst"), F.lit("member_of").alias("kind"))


def relations(entities: DataFrame, kinds: Mapping[str, tuple[Column, Column]], known: DataFrame) -> DataFrame:
    """(src, dst, kind, resolved): a row for each relation kind (condition, target) that holds for an entity (id).

    All kinds are read in one pass; resolved tells whether the target is known (id).
    """
    each = F.array_compact(F.array(*[F.when(where & target.isNotNull(), F.struct(F.lit(k).alias("kind"), target.cast("string").alias("dst"))) for k, (where, target) in kinds.items()]))
    rows = entities.select(F.col("id").cast("string").alias("src"), F.explode(each).alias("r")).select("src", "r.dst", "r.kind")
    ids = known.select(F.col("id").cast("string").alias("dst")).distinct().withColumn("_k", F.lit(True))
    return rows.join(ids, "dst", "left").select("src", "dst", "kind", F.coalesce("_k", F.lit(False)).alias("resolved"))


def first_connector(pairs: DataFrame, order: str = "id") -> DataFrame:
    """(src, dst, n, first): boundary pairs counted for each direction, with their first connector."""
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min_by(order, order).alias("first"))


def layer_visible(layer: Column, wanted: str, node: Column | None = None, route: Column | None = None) -> Column:
    """The layer is the wanted one or none at all, or the node lies on the route (an array)."""
    own = F.coalesce(layer == wanted, F.lit(True))
    return own if node is None else own | F.coalesce(F.array_contains(route, node), F.lit(False))
