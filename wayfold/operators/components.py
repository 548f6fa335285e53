"""Connected components of an edge list by alternating large-star and small-star rounds.

Every round is one aggregation and one join over the edges; the number of rounds grows with the
logarithm of the longest chain. Hot vertices (star centres) are pre-aggregated by map-side
minimum and split by Spark's skew join. Nothing is collected but one count a round: whether all edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.storage import discard, materialize


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every u has one v, and no v is a u. Each v then is the least of its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    loose = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return loose.agg(F.count("*")).first()[0] == 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each vertex's larger (large) or smaller (small) neighbours at its least neighbour."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:  # repeated rows do no harm to the small stars that follow
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of an undirected edge list; component is the least id.

    Null endpoints are dropped, self loops keep their vertex, repeated edges count once; an empty
    list gives an empty result. Raises if max_rounds do not suffice, and never stops half way.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    loops = given.filter("u = v").select(F.col("u").alias("id"))
    work = materialize(given.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(work):
            break
        new = materialize(_star(_star(work, True), False), "edges")
        discard(work)
        work = new
    else:
        raise RuntimeError("components did not settle")
    labels = work.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = labels.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    labels = labels.union(roots)
    alone = loops.distinct().join(labels, "id", "left_anti").withColumn("component", F.col("id"))
    return labels.union(alone)
