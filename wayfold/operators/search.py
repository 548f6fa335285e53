"""Search over node labels with aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.catalog import in_chinese_order

TEXT = ("id", "label", "region", "floor")


def expand_tokens(query: str, aliases: DataFrame) -> DataFrame:
    """(token, candidate): each token itself, its exact alias targets, and targets of aliases that contain it or that it contains.

    aliases: alias, target. Substrings count from two characters on. The query's few tokens are
    literals, so aliases are scanned once, without a join.
    """
    tokens = list(dict.fromkeys(query.lower().split()))
    out = aliases.select(F.lower("alias").alias("a"), F.lower("target").alias("target"))
    rows = []
    for t in tokens:
        near = F.lit(len(t) >= 2) & (F.length("a") >= 2) & (F.contains(F.col("a"), F.lit(t)) | F.contains(F.lit(t), F.col("a")))
        rows.append(F.when((F.col("a") == t) | near, F.struct(F.lit(t).alias("token"), F.col("target").alias("candidate"))))
    own = aliases.sparkSession.createDataFrame([(t, t) for t in tokens], "token string, candidate string")
    if not rows:
        return own
    return own.union(out.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.token", "x.candidate")).distinct()


def search(nodes: DataFrame, query: str, aliases: DataFrame | None = None, limit: int = 20, most_candidates: int = 1000) -> DataFrame:
    """(id, label, kind, region, score): nodes that hold a candidate of every token, best score first, then by label in Chinese collation.

    Score is 4 for the whole query in the label, 3 in the id, 1 in the region. An empty query gives no row here;
    its order by kind is catalog.kind_first(). A query with over most_candidates alias targets raises.
    """
    words = list(dict.fromkeys(query.lower().split()))
    if not words:
        return nodes.limit(0).select("id", "label", "kind", "region", F.lit(0).alias("score"))
    wanted = {t: {t} for t in words}
    if aliases is not None:
        rows = expand_tokens(query, aliases).limit(most_candidates + 1).collect()
        if len(rows) > most_candidates:
            raise ValueError("too many alias candidates")
        for r in rows:
            wanted[r.token].add(r.candidate)
    every = F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TEXT if c in nodes.columns]))
    hit = F.lit(True)
    for candidates in wanted.values():
        some = F.lit(False)
        for c in sorted(candidates):
            some = some | F.contains(every, F.lit(c))
        hit = hit & some
    q = F.lit(" ".join(query.lower().split()))
    score = sum((F.when(F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), q), n).otherwise(0) for c, n in (("id", 3), ("region", 1))),
                F.when(F.contains(F.lower("label"), q), 4).otherwise(0))
    return nodes.filter(hit).select("id", "label", "kind", "region", score.alias("score")).orderBy(F.desc("score"), in_chinese_order("label"), "id").limit(limit)


def localised_aliases(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(alias, target): translations (label, zh) of node labels as aliases of the label."""
    return nodes.join(names, "label").filter(F.coalesce(F.col("zh"), F.lit("")) != "").select(F.lower("zh").alias("alias"), "label").distinct().withColumnRenamed("label", "target")
