"""Record packages: one JSON object a line, isolated line by line, validated, published or quarantined.

A package file is split into lines with their numbers; (package position, line) is the global
order in which the first record of an id wins. Every verdict is a column, so a load is one lazy plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators.graph import dangling, unknown_conditions
from wayfold.operators.relational import first_wins
from wayfold.storage import materialize

PACKAGE_ID = "^[a-z0-9][a-z0-9-]*$"


@dataclass(frozen=True)
class GraphTables:
    nodes: DataFrame
    edges: DataFrame
    conditions: DataFrame
    quarantine: DataFrame
    packages: DataFrame


def read_packages(spark: SparkSession, manifest: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lines, failed) of a manifest (id, path in the folder, pos): (package_id, pos, line, raw), and packages whose id or file is bad.

    Files are read in splits, so a package may be of any size; a line's number is its place in its
    split and the lines of the splits before it. Manifest rows without a file fail alone, files that
    cannot be read are skipped and fail like absent ones. An empty file has no line and fails too.
    """
    source = spark.read.option("ignoreCorruptFiles", True).text(folder)
    name = F.get(F.split(F.col("_metadata.file_path"), re.escape(urlparse(folder).path.rstrip("/")) + "/", 2), F.lit(1))
    raw = source.select(name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    raw = materialize(raw, "raw")
    splits = raw.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(splits.select("path", "block", "first", before.alias("before")), ["path", "block"])
    lines = placed.select("path", (F.col("at") - F.col("first") + F.col("before") + 1).cast("int").alias("line"), F.regexp_replace("raw", "\r$", "").alias("raw"))
    names = manifest.filter(F.col("id").rlike(PACKAGE_ID))
    got = lines.join(names, "path").select(F.col("id").alias("package_id"), "pos", "line", "raw")
    failed = names.join(splits.select("path").distinct(), "path", "left_anti").select(F.col("id").alias("package_id"), F.lit("file not found").alias("reason"))
    bad = manifest.filter(~F.col("id").rlike(PACKAGE_ID)).select(F.col("id").alias("package_id"), F.lit("invalid package id").alias("reason"))
    return got, failed.union(bad)


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _part(v, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v, path: str) -> Column:
    """The string at path; null if there is none or it is no string."""
    return F.when(_is_string(_part(v, path)), F.try_variant_get(v, path, "string"))


def parse_lines(files: DataFrame) -> DataFrame:
    """(package_id, pos, line, payload, state) of files (package_id, pos, text) or their lines (package_id, pos, line, raw): a row for each line that is not blank.

    state is ok, unparseable or no-envelope; header lines are ok and carry a schema.
    """
    if "raw" not in files.columns:
        files = files.select("package_id", "pos", F.posexplode(F.split("text", "\r?\n")).alias("i", "raw")).withColumn("line", F.col("i") + 1)
    lines = files.filter(F.trim("raw") != "").select("package_id", "pos", "line", F.try_parse_json("raw").alias("payload"))
    v = F.col("payload")
    envelope = _is_string(_part(v, "$.type")) & _is_object(_part(v, "$.record")) | _text(v, "$.schema").isNotNull()
    return lines.withColumn("state", F.when(v.isNull(), "unparseable").when(~envelope, "no-envelope").otherwise("ok"))


def _quarantined(df: DataFrame, kind: str, reason, record: bool = True) -> DataFrame:
    body = F.to_json("record") if record else F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), "package_id", reason.alias("reason"), "line", body.alias("record"))


def load_packages(files: DataFrame, manifest: DataFrame, schema: str, extra_conditions: DataFrame | None = None) -> GraphTables:
    """Nodes, edges, conditions, quarantine and package states of files (package_id, pos, text).

    manifest: (id, and any others) declares packages; an undeclared package is rejected. A package
    without a header line (payload schema equal to schema) is skipped and its bad lines are kept in
    quarantine. Of one id the first record in (pos, line) order is published; later nodes and edges
    go to quarantine, later conditions are ignored. Edges with a missing endpoint go to quarantine at
    the end, in which case their order does not matter. extra_conditions (id, label) are registered
    besides. An absent cost is 1, an absent risk 0, an absent label the id; notes tell so.
    """
    declared = files.join(manifest.select(F.col("id").alias("package_id")), "package_id", "left_semi")
    lines = materialize(parse_lines(declared), "lines")
    v = F.col("payload")
    is_header = (F.col("state") == "ok") & F.coalesce(_text(v, "$.schema") == schema, F.lit(False))
    headers = lines.filter(is_header).groupBy("package_id").agg(F.max_by(F.to_json("payload"), "line").alias("header"))
    body = lines.filter(~is_header).join(headers.select("package_id"), "package_id", "left_semi")
    bad = lines.filter(~is_header & ((F.col("state") != "ok") | ~(_is_string(_part(v, "$.type")) & _is_object(_part(v, "$.record")))))
    quarantine = bad.select(F.lit("record-line").alias("kind"), "package_id", F.when(F.col("state") == "unparseable", "unparseable line").otherwise("record without {type, record} envelope").alias("reason"), "line", F.lit(None).cast("string").alias("record"))
    good = body.filter((F.col("state") == "ok") & _is_string(_part(v, "$.type")) & _is_object(_part(v, "$.record")))
    rows = good.select("package_id", "pos", "line", _text(v, "$.type").alias("type"), _part(v, "$.record").alias("record"))
    r, order = F.col("record"), ["pos", "line"]
    blank = lambda c: c.isNull() | (F.trim(c) == "")

    def of(kind):
        return rows.filter(F.col("type") == kind)

    nodes = of("node").withColumns({"id": _text(r, "$.id"), "label": _text(r, "$.label"), "region": _text(r, "$.region"), "layer": _text(r, "$.layer"), "node_kind": _text(r, "$.kind"), "is_grace_anchor": F.coalesce(F.try_variant_get(r, "$.isGraceAnchor", "boolean"), F.lit(False))})
    quarantine = quarantine.union(_quarantined(nodes.filter(blank(F.col("id"))), "node", F.lit("node id is missing or not a string")))
    nodes, again = first_wins(nodes.filter(~blank(F.col("id"))), "id", order)
    quarantine = quarantine.union(_quarantined(again, "node", F.lit("duplicate node id; first published record wins")))
    note = F.when(blank(F.col("label")), F.lit("missing display label; using id as fallback"))
    nodes = nodes.withColumns({"degraded": F.array_compact(F.array(note)), "label": F.when(F.coalesce(F.col("label"), F.lit("")) == "", F.col("id")).otherwise(F.col("label"))})
    nodes = materialize(nodes.select("id", "label", "region", "layer", "node_kind", "is_grace_anchor", "degraded", "package_id", "pos", "line", F.to_json("record").alias("record")), "nodes")

    number = lambda p: F.coalesce(F.try_variant_get(r, p, "double"), F.lit(float("nan")))
    absent = lambda p: _part(r, p).isNull() | F.coalesce(F.schema_of_variant(_part(r, p)) == "VOID", F.lit(False))
    edges = of("edge").withColumns({
        "given": F.try_variant_get(r, "$.id", "string"), "src": _text(r, "$.from"), "dst": _text(r, "$.to"),
        "cost": F.when(absent("$.cost"), F.lit(None)).otherwise(number("$.cost")), "risk": F.when(absent("$.risk"), F.lit(None)).otherwise(number("$.risk")),
        "requires": F.coalesce(F.try_variant_get(r, "$.requires", "array<string>"), F.array().cast("array<string>")),
        "routeable": F.try_variant_get(r, "$.routeable", "boolean")})
    reason = F.when(blank(F.col("src")), "edge from is missing or not a string").when(blank(F.col("dst")), "edge to is missing or not a string")
    edges = edges.withColumn("reason", reason)
    quarantine = quarantine.union(_quarantined(edges.filter("reason is not null"), "edge", F.col("reason")))
    ok = edges.filter("reason is null")
    named, again = first_wins(ok.filter("given is not null"), "given", order)
    quarantine = quarantine.union(_quarantined(again, "edge", F.lit("duplicate edge id; first published record wins")))
    valid = named.unionByName(ok.filter("given is null"))
    # the number of a generated id is that of the package's valid edges so far
    at = F.row_number().over(W.partitionBy("package_id").orderBy("line")) - 1
    made = F.concat_ws(":", "package_id", "src", "dst", at.cast("string"))
    edges = valid.withColumn("id", F.coalesce("given", made))
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    notes = F.array_compact(F.array(F.when(F.col("given").isNull(), "edge id missing; generated"), F.when(missing("cost"), "missing cost; defaulted to 1"), F.when(missing("risk"), "missing risk; defaulted to 0")))
    edges = edges.withColumns({"degraded": notes, "cost": F.coalesce("cost", F.lit(1.0)), "risk": F.coalesce("risk", F.lit(0.0))})
    edges = materialize(edges.select("id", "src", "dst", "cost", "risk", "requires", "routeable", "degraded", "package_id", "pos", "line", F.to_json("record").alias("body")), "edges")

    conditions = of("condition").withColumns({"id": _text(r, "$.id"), "label": _text(r, "$.label"), "hint": _text(r, "$.hint")})
    quarantine = quarantine.union(_quarantined(conditions.filter(blank(F.col("id"))), "condition", F.lit("condition id is missing or not a string")))
    conditions, _ = first_wins(conditions.filter(~blank(F.col("id"))), "id", order)
    conditions = conditions.select("id", F.when(F.coalesce(F.col("label"), F.lit("")) == "", F.col("id")).otherwise(F.col("label")).alias("label"), "hint", "package_id")
    if extra_conditions is not None:
        late = extra_conditions.join(conditions.select("id"), "id", "left_anti")
        conditions = conditions.unionByName(late, allowMissingColumns=True)

    lost = materialize(dangling(nodes, edges), "dangling")
    quarantine = quarantine.union(lost.select(F.lit("dangling-edge"), "package_id", F.lit("endpoint is not an active node"), "line", F.col("body")))
    edges = unknown_conditions(edges.join(lost.select("id"), "id", "left_anti"), conditions)
    counts = nodes.groupBy("package_id").agg(F.count("*").alias("node_count")).join(edges.groupBy("package_id").agg(F.count("*").alias("edge_count")), "package_id", "full")
    gone = lost.groupBy("package_id").agg(F.count("*").alias("quarantined_count"))
    packages = (
        manifest.select(F.col("id").alias("package_id")).join(files.select("package_id", F.lit(True).alias("seen")).distinct(), "package_id", "left")
        .join(headers.select("package_id", "header"), "package_id", "left").join(counts, "package_id", "left").join(gone, "package_id", "left")
        .select("package_id", F.when(F.col("header").isNotNull(), "loaded").when(F.col("seen"), "failed").otherwise("pending").alias("status"),
                *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("node_count", "edge_count", "quarantined_count")])
    )
    return GraphTables(nodes, edges, conditions, quarantine, packages)


def diagnostics(g: GraphTables) -> DataFrame:
    """(package_id, status, counts, problems): each package with its quarantined records grouped."""
    problems = g.quarantine.groupBy("package_id").agg(F.count("*").alias("n_problems"), F.array_sort(F.collect_list(F.struct("line", "kind", "reason"))).alias("problems"))
    return g.packages.join(problems, "package_id", "full").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))


def write_packages(g_nodes: DataFrame, g_edges: DataFrame, conditions: DataFrame, schema: str, path: str) -> None:
    """One folder a package of JSON lines: header, nodes, edges and the conditions its edges refer to.

    nodes, edges: any columns beside package_id and id. Rows are dealt by ranges of the order, so a
    large package is several files, whose names are in the order of their lines; see written_lines().
    """
    row = lambda df, kind, rank: df.select("package_id", F.lit(rank).alias("_k"), "id", F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*[c for c in df.columns if c not in ("package_id", "pos", "line")]).alias("record"))).alias("value"))
    ids = g_nodes.select("package_id").union(g_edges.select("package_id")).distinct()
    head = ids.select("package_id", F.lit(0).alias("_k"), F.lit("").alias("id"), F.to_json(F.struct(F.lit(schema).alias("schema"), F.struct(F.col("package_id").alias("id")).alias("package"))).alias("value"))
    used = g_edges.select("package_id", F.explode("requires").alias("id")).distinct().join(conditions.drop("package_id"), "id")
    out = head.union(row(g_nodes, "node", 1)).union(row(g_edges, "edge", 2)).union(row(used, "condition", 3))
    parts = out.repartitionByRange("package_id", "_k", "id").sortWithinPartitions("package_id", "_k", "id")
    parts.select("package_id", "value").write.partitionBy("package_id").text(path)


def written_lines(spark: SparkSession, path: str) -> DataFrame:
    """(package_id, line, raw) of what write_packages() wrote; lines are numbered through all files of a package.

    A line's number is its place in its split and the lines of the splits before it, so no task reads a whole package.
    """
    raw = spark.read.text(path).select("package_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    raw = materialize(raw, "raw")
    splits = raw.groupBy("package_id", "file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("package_id").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(splits.select("package_id", "file", "block", "first", before.alias("before")), ["package_id", "file", "block"])
    return placed.select("package_id", (F.col("at") - F.col("first") + F.col("before") + 1).cast("int").alias("line"), "raw")


def manifest_of(nodes: DataFrame, edges: DataFrame, bridge: str = "bridge") -> DataFrame:
    """(id, isolated_record_count, regions, layers, condition_count) a package, and its totals with id null."""
    n = nodes.groupBy("package_id").agg(F.count("*").alias("nodes"), F.array_sort(F.collect_set(F.coalesce("region", F.lit("")))).alias("regions"), F.array_sort(F.collect_set(F.coalesce("layer", F.lit("")))).alias("layers"))
    e = edges.groupBy("package_id").agg(F.count("*").alias("edges"))
    c = edges.select("package_id", F.explode("requires").alias("c")).groupBy("package_id").agg(F.countDistinct("c").alias("conditions"))
    out = n.join(e, "package_id", "full").join(c, "package_id", "left").na.fill(0, ["nodes", "edges", "conditions"])
    total = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges"), F.count_if(F.col("package_id") == bridge).alias("bridge_edges")))
    return out.withColumnRenamed("package_id", "id").unionByName(total, allowMissingColumns=True)
