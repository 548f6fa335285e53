"""Joins that bind evidence rows of several sources to each other, with a status for what does not bind.

Every side that may hold a key more than once is counted or reduced to one row a key before it meets
the other, so no join multiplies a hot key unless the operator's result itself has that many rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.relational import _keys, resolve_unique


def fan_in(base: DataFrame, key: str, sides: Mapping[str, DataFrame], optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(joined, errors): base with a struct column for each side that has just one row for the key.

    errors (key, side, problem) names each side that is missing or duplicate. Rows of base with an
    error are left out; a missing side is no error if it is optional and is null then.
    """
    out, checks = base, []
    for name, side in sides.items():
        others = [c for c in side.columns if c != key]
        one = side.groupBy(key).agg(F.count("*").alias(f"_n_{name}"), F.min(F.struct(*others)).alias(name))
        out = out.join(one, key, "left")
        n = F.coalesce(F.col(f"_n_{name}"), F.lit(0))
        problem = F.when(n > 1, "duplicate")
        problem = problem if name in optional else problem.when(n == 0, "missing")
        checks.append(F.when(problem.isNotNull(), F.struct(F.lit(name).alias("side"), problem.alias("problem"))))
    out = out.withColumn("_bad", F.array_compact(F.array(*checks)))
    errors = out.select(key, F.explode("_bad").alias("e")).select(key, "e.side", "e.problem")
    return out.filter(F.size("_bad") == 0).drop("_bad", *[f"_n_{s}" for s in sides]), errors


def checked_binding(left: DataFrame, bindings: DataFrame, key: str, agree: Sequence[str], targets: DataFrame, target: Sequence[str], node: str) -> DataFrame:
    """left with binding_status and node: a given binding counts only if it still holds.

    bindings (key, agree columns, target columns, node) are checked again: the agree columns must
    equal left's, and targets (target columns, node) must hold just one row for the target, of the
    same node. status is exact, disagrees, target_not_unique, other_node or no_binding.
    """
    b = bindings.select(key, *[F.col(c).alias(f"_{c}") for c in agree], *[F.col(c).alias(f"_t_{c}") for c in target], F.col(node).alias("_node"), F.lit(True).alias("_has"))
    one = targets.groupBy(*[F.col(c).alias(f"_t_{c}") for c in target]).agg(F.count("*").alias("_n"), F.min(node).alias("_found"))
    got = left.join(b, key, "left").join(one, [f"_t_{c}" for c in target], "left")
    same = F.lit(True)
    for c in agree:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = (
        F.when(F.col("_has").isNull(), "no_binding").when(~same, "disagrees").when(F.coalesce("_n", F.lit(0)) != 1, "target_not_unique")
        .when(~F.col("_found").eqNullSafe(F.col("_node")), "other_node").otherwise("exact")
    )
    return got.withColumn("binding_status", status).withColumn(node, F.when(F.col("binding_status") == "exact", F.col("_node"))).select(*left.columns, "binding_status", node)


def scope_expand(left: DataFrame, key: str, on: Sequence[str], refs: DataFrame, scope: Sequence[str], category: str = "category", flag: str = "flag") -> DataFrame:
    """(key, exact_refs, scopes, conditions, actions, flags): exact references of each left row, and all references of the events they stand in.

    refs: id, on columns, scope columns, category, flag; a reference that is given again (by id) counts once.
    """
    once = refs.dropDuplicates(["id"])
    exact = left.select(key, *on).join(once.select("id", *on, *[c for c in scope if c not in on]), list(on)).select(key, "id", *scope)
    per = exact.groupBy(key).agg(F.count("*").alias("exact_refs"), F.countDistinct(*scope).alias("scopes"))
    scoped = exact.select(key, *scope).distinct().join(once.select(*scope, category, flag), list(scope))
    wide = scoped.groupBy(key).agg(
        F.count_if(F.col(category) == "condition").alias("conditions"), F.count_if(F.col(category) == "action").alias("actions"), F.array_sort(F.collect_set(flag)).alias("flags"))
    out = left.select(key).join(per, key, "left").join(wide, key, "left").na.fill(0, ["exact_refs", "scopes", "conditions", "actions"])
    return out.withColumn("flags", F.coalesce("flags", F.array().cast(dict(out.dtypes)["flags"])))


def destination_bindings(refs: DataFrame, args: str, names: Sequence[str], targets: DataFrame, entity: str, node: str) -> DataFrame:
    """(binding_id, id, node): references (id, args array<struct<name, value>>) bound to the one target of an entity argument.

    A target entity with several rows binds nothing; of equal binding ids one stays.
    """
    one = targets.groupBy(entity).agg(F.count("*").alias("_n"), F.min(node).alias(node)).filter("_n = 1").drop("_n")
    wanted = refs.select("id", F.explode(args).alias("a")).filter(F.col("a.name").isin(*names)).select("id", F.col("a.value").alias(entity))
    made = wanted.join(one, entity).select(F.concat_ws(":", F.lit("warp"), "id", node).alias("binding_id"), "id", node)
    return made.dropDuplicates(["binding_id"])


def relate(left: DataFrame, key: str, on: Sequence[str], events: DataFrame, event: str, targets: str) -> tuple[DataFrame, DataFrame]:
    """(relations, unresolved): key, event, target of left rows (on columns, array of targets) for each event that agrees on `on`.

    unresolved (key, reason): target_unresolved without any target, event_missing with targets but no event.
    """
    known = events.select(*on).distinct().withColumn("_event", F.lit(True))
    marked = left.join(known, list(on), "left")
    reason = F.when(F.coalesce(F.size(targets), F.lit(0)) <= 0, "target_unresolved").when(F.col("_event").isNull(), "event_missing")
    rows = left.select(key, *on, F.explode(targets).alias("target")).join(events.select(*on, event), list(on))
    return rows.select(key, event, "target"), marked.withColumn("reason", reason).filter("reason is not null").select(key, "reason")


def left_chain(left: DataFrame, steps: Sequence[tuple[str, DataFrame, Sequence[str], str, str]]) -> DataFrame:
    """left with <name> for each step (name, table, keys, payload, order): the payload of the last row of the composite key, else null."""
    for name, table, keys, payload, order in steps:
        left = left.join(table.groupBy(*keys).agg(F.max_by(payload, order).alias(name)), list(keys), "left")
    return left


def by_array_key(left: DataFrame, key: str, records: DataFrame, ids: str, payload: str, order: str) -> DataFrame:
    """left with record (payload of the last record whose array of ids holds the key) and link_status: linked or missing."""
    last = records.select(F.explode(ids).alias(key), payload, order).groupBy(key).agg(F.max_by(payload, order).alias("record"))
    got = left.join(last.withColumn("_hit", F.lit(True)), key, "left")
    return got.withColumn("link_status", F.when(F.col("_hit"), "linked").otherwise("missing")).drop("_hit")


def multi_field_lookup(df: DataFrame, key: str, fields: Mapping[str, str], texts: DataFrame) -> DataFrame:
    """(key, field, table, id, language, text): each field (column: table) of df looked up in texts (table, id, language, text), distinct."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("table"), F.col(f).cast("bigint").alias("id")) for f, t in fields.items()])
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*").filter("id is not null").join(texts.distinct(), ["table", "id"]).select(key, "field", "table", "id", "language", "text").distinct()


def unique_partner(left: DataFrame, right: DataFrame, on, payload: str, where: Column | None = None) -> DataFrame:
    """left joined with payload of right where the key has just one distinct payload; other rows are dropped."""
    right = right if where is None else right.filter(where)
    one = right.groupBy(*_keys(on)).agg(F.min(payload).alias(payload), F.max(payload).alias("_hi")).filter(F.col(payload) == F.col("_hi")).drop("_hi")
    return left.join(one, _keys(on))


def candidate_sets(left: DataFrame, right: DataFrame, on, fields: Sequence[str]) -> DataFrame:
    """left with n_candidates and, for each field, its number of distinct values among the rows of its key (0 without any)."""
    per = right.groupBy(*_keys(on)).agg(F.count("*").alias("n_candidates"), *[F.countDistinct(f).alias(f"n_{f}") for f in fields])
    return left.join(per, _keys(on), "left").na.fill(0, ["n_candidates", *[f"n_{f}" for f in fields]])


def expand_ends(pairs: DataFrame, faces: DataFrame, mesh: str = "mesh") -> DataFrame:
    """(id, pos, from_mesh, to_mesh, from_face, to_face, problem): each face pair of connectors (id, ends array<struct<f, t>>, from_mesh, to_mesh).

    faces (mesh, n): the number of faces; problem is mesh_missing or face_out_of_range, else null.
    """
    rows = pairs.select("id", f"from_{mesh}", f"to_{mesh}", F.posexplode("ends").alias("pos", "e"))
    for side in ("from", "to"):
        rows = rows.join(faces.select(F.col(mesh).alias(f"{side}_{mesh}"), F.col("n").alias(f"_{side}")), f"{side}_{mesh}", "left")
    good = in_range(F.col("e.f"), F.col("_from")) & in_range(F.col("e.t"), F.col("_to"))
    problem = F.when(F.col("_from").isNull() | F.col("_to").isNull(), "mesh_missing").when(~good, "face_out_of_range")
    return rows.select("id", "pos", f"from_{mesh}", f"to_{mesh}", F.col("e.f").alias("from_face"), F.col("e.t").alias("to_face"), problem.alias("problem"))


def in_range(index: Column, n: Column) -> Column:
    """0 <= index < n; a null is not in range."""
    return F.coalesce((index >= 0) & (index < n), F.lit(False))


def cascade_status(left: DataFrame, key: str, tables: Sequence[tuple[str, DataFrame, str]], public: DataFrame) -> DataFrame:
    """left with status and text from the first table (name, rows, payload) that holds the key, else missing, and is_public."""
    statuses, texts, out = [], [], left
    for name, rows, payload in tables:
        out = out.join(rows.groupBy(key).agg(F.min(payload).alias(f"_{name}")), key, "left")
        statuses.append(F.when(F.col(f"_{name}").isNotNull(), name))
        texts.append(F.col(f"_{name}"))
    out = out.join(public.select(key).distinct().withColumn("_public", F.lit(True)), key, "left")
    return out.select(*left.columns, F.coalesce(*statuses, F.lit("missing")).alias("status"), F.coalesce(*texts).alias("text"), F.coalesce("_public", F.lit(False)).alias("is_public"))


def name_points(names: DataFrame, points: DataFrame, region: str = "region") -> DataFrame:
    """names (id, variants array, region) with point: the one point (name, region, point) of any variant, narrowed to the own region if any lies there; else null."""
    # whether a name has none, one or more points is told by its least and greatest one, so points are one row a name before they meet names
    per = points.groupBy("name", F.col(region).alias("_r")).agg(F.min("point").alias("_lo"), F.max("point").alias("_hi"))
    every = per.groupBy("name").agg(F.min("_lo").alias("_all_lo"), F.max("_hi").alias("_all_hi"))
    own = per.filter("_r is not null").withColumnsRenamed({"_lo": "_own_lo", "_hi": "_own_hi"})
    rows = names.select("id", F.col(region).alias("_r"), F.explode(F.array_distinct("variants")).alias("name"))
    found = rows.join(every, "name").join(own, ["name", "_r"], "left").groupBy("id").agg(
        *[f(c).alias(c) for f, c in ((F.min, "_own_lo"), (F.max, "_own_hi"), (F.min, "_all_lo"), (F.max, "_all_hi"))])
    point = F.when(F.col("_own_lo").isNotNull(), F.when(F.col("_own_lo") == F.col("_own_hi"), F.col("_own_lo"))).when(F.col("_all_lo") == F.col("_all_hi"), F.col("_all_lo"))
    return names.join(found.select("id", point.alias("point")), "id", "left")


def binding_mismatches(bindings: DataFrame, source: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, problem): bindings (id, source_id, name, formal_id) without their source, of another name than the source's (source_id, name), or without a node (id)."""
    s = source.groupBy("source_id").agg(F.min("name").alias("_name"))
    n = nodes.select(F.col("id").alias("formal_id")).distinct().withColumn("_node", F.lit(True))
    got = bindings.join(s, "source_id", "left").join(n, "formal_id", "left")
    problem = F.when(F.col("_name").isNull(), "source_missing").when(F.col("_name") != F.col("name"), "name_differs").when(F.col("_node").isNull(), "node_missing")
    return got.withColumn("problem", problem).filter("problem is not null").select("id", "problem")


def candidate_index(records: DataFrame, binding: str = "binding", candidates: str = "candidates") -> DataFrame:
    """(formal_id, record): ids named by exactly one record (id), by its binding or, without one, its candidates."""
    ids = F.when(F.col(binding).isNotNull(), F.array(binding)).otherwise(F.array_distinct(candidates))
    rows = records.select("id", F.explode(ids).alias("formal_id"))
    return rows.groupBy("formal_id").agg(F.count("*").alias("_n"), F.min("id").alias("record")).filter("_n = 1").drop("_n")


def single_candidate_index(records: DataFrame, candidates: str, order: str) -> DataFrame:
    """(formal_id, record): of records (id) with just one candidate, the last one of each candidate."""
    return records.filter(F.size(candidates) == 1).groupBy(F.col(candidates)[0].alias("formal_id")).agg(F.max_by("id", order).alias("record"))


def valid_ids(records: DataFrame, known: DataFrame, binding: str = "binding", candidates: str = "candidates") -> DataFrame:
    """(id, valid): each record's binding, else its candidates, that exist in known (formal_id), distinct and in order."""
    ids = F.when(F.col(binding).isNotNull(), F.array(binding)).otherwise(F.array_distinct(candidates))
    rows = records.select("id", F.posexplode(ids).alias("pos", "formal_id")).join(known.select("formal_id").distinct(), "formal_id")
    got = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "formal_id"))), lambda x: x["formal_id"]).alias("valid"))
    out = records.select("id").join(got, "id", "left")
    return out.withColumn("valid", F.coalesce("valid", F.array().cast(dict(got.dtypes)["valid"])))


def first_resolvable(df: DataFrame, key: str, fields: Sequence[str], table: DataFrame, name: str, payload: str) -> DataFrame:
    """df with payload of the first of the fields whose value is a name in table; null if none is."""
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f).alias(name)) for i, f in enumerate(fields)])
    one = table.groupBy(name).agg(F.min(payload).alias(payload))
    best = df.select(key, F.explode(rows).alias("r")).select(key, "r.*").join(one, name).groupBy(key).agg(F.min_by(payload, "rank").alias(payload))
    return df.join(best, key, "left")


def option_union(sources: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, source): all keys, each with the first listed source that has it."""
    out = None
    for i, (name, rows) in enumerate(sources):
        part = rows.select(key, F.struct(F.lit(i).alias("rank"), F.lit(name).alias("source")).alias("s"))
        out = part if out is None else out.union(part)
    return out.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("s").alias("s")).select(key, "s.source")


def graft(nodes: DataFrame, catalog: DataFrame, blocked: Sequence[str], per_row: int = 6, step: float = 10.0) -> DataFrame:
    """(id, node_id, is_new, x, y): catalog rows (id, name, layer, region) as nodes.

    A known id maps to itself, a blocked name is skipped, the others become nodes on slots of their layer and region.
    """
    from pyspark.sql.window import Window as W

    known = nodes.select("id").distinct().withColumn("_known", F.lit(True))
    rows = catalog.filter(~F.col("name").isin(list(blocked))).join(known, "id", "left").withColumn("is_new", F.col("_known").isNull())
    slot = F.row_number().over(W.partitionBy("layer", "region", "is_new").orderBy("id")) - 1
    rows = rows.withColumn("_s", slot)
    place = lambda v: F.when(F.col("is_new"), v)
    return rows.select("id", F.col("id").alias("node_id"), "is_new", place((F.col("_s") % per_row) * step).alias("x"), place(F.floor(F.col("_s") / per_row) * step).alias("y"))


def endpoint_cascade(ends: DataFrame, nodes: DataFrame, special: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, created): ends (name, region) with node and basis: region, special, global or created.

    The node of the name in the region if there is just one, else a special case (name, node), else
    the node of a name that stands once in all regions, else a new node, one for each (name, region).
    """
    got = resolve_unique(ends, nodes.select("name", "region", "id"), ["name", "region"], "id", "_a")
    got = got.join(special.groupBy("name").agg(F.min("node").alias("_b")), "name", "left")
    got = resolve_unique(got, nodes.select("name", "id"), "name", "id", "_c")
    made = F.concat_ws(":", F.lit("candidate"), F.coalesce("region", F.lit("")), "name")
    node = F.coalesce(F.col("_a").cast("string"), F.col("_b").cast("string"), F.col("_c").cast("string"), made)
    basis = F.when(F.col("_a").isNotNull(), "region").when(F.col("_b").isNotNull(), "special").when(F.col("_c").isNotNull(), "global").otherwise("created")
    out = got.select(*ends.columns, node.alias("node"), basis.alias("basis"))
    return out, out.filter("basis = 'created'").select(F.col("node").alias("id"), "name", "region").dropDuplicates(["id"])


def leg_edges(legs: DataFrame, groups: DataFrame, assessments: DataFrame) -> DataFrame:
    """legs (id, src, dst, group) as edges of cost 0 that no route takes, with the group's title and the leg's verdict where there are any."""
    g = groups.groupBy(F.col("group")).agg(F.min("title").alias("title"))
    a = assessments.groupBy("id").agg(F.min("verdict").alias("verdict"))
    return legs.join(g, "group", "left").join(a, "id", "left").select("id", "src", "dst", "title", "verdict", F.lit(0.0).alias("cost"), F.lit(False).alias("routeable"))
