"""Audits as violation queries: each check gives rows (rule, id, detail), and intact data gives none.

Rules are joined and counted as DataFrames, so an audit is one lazy plan; require() runs it and raises.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a translation that need no Chinese text.
PLAIN_LEVELS = ("already_zh", "uncovered")
_CJK = "[\\u4e00-\\u9fff]"


def violation(rows: DataFrame, rule: str, key, detail=None) -> DataFrame:
    """rows as (rule, id, detail) of one rule."""
    key = F.col(key) if isinstance(key, str) else key
    detail = F.lit("") if detail is None else F.col(detail) if isinstance(detail, str) else detail
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("id"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def all_of(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


def require(violations: DataFrame, most: int = 40) -> None:
    """Raise with the first violations if there are any."""
    found = violations.orderBy("rule", "id").limit(most).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['id']} {r['detail']}".strip() for r in found))


def repeated(df: DataFrame, rule: str, key: str) -> DataFrame:
    return violation(df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), rule, key, "n")


def absent(df: DataFrame, rule: str, key: str, ref: str, known: DataFrame, known_key: str, detail: str | None = None) -> DataFrame:
    """Rows whose ref is not among known; a null ref counts as absent."""
    ids = known.select(F.col(known_key).alias(ref)).distinct()
    return violation(df.join(ids, ref, "left_anti"), rule, key, detail or ref)


def count_differs(rule: str, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row if the tables differ in their number of rows."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    both = n(found, "found").join(n(wanted, "wanted"))  # one row each
    return violation(both.filter("found <> wanted"), rule, F.lit("count"), F.concat_ws("/", "found", "wanted"))


def package_audit(nodes: DataFrame, edges: DataFrame, conditions: DataFrame, source_nodes: DataFrame, source_edges: DataFrame, source_conditions: DataFrame,
                  bad_lines: DataFrame, injected: Sequence[str] = (), bridge: str = "bridge") -> DataFrame:
    """Violations of a split graph (nodes, edges, conditions: id, package_id; edges also src, dst, requires).

    unparseable-line (bad_lines: package_id, line), repeated ids, counts other than the source's,
    dangling endpoints, edges of a package (other than the bridge) that leave it, conditions that are
    nowhere defined, or that the source defines but no package ships. injected conditions are fine.
    """
    ends = edges.select("id", "package_id", F.explode(F.array(F.struct(F.lit("from").alias("side"), F.col("src").alias("node")), F.struct(F.lit("to").alias("side"), F.col("dst").alias("node")))).alias("e")).select("id", "package_id", "e.side", "e.node")
    own = nodes.select(F.col("id").alias("node"), "package_id").distinct()
    leaks = ends.filter(F.col("package_id") != bridge).join(own, ["node", "package_id"], "left_anti").select("id").distinct()
    needs = edges.select("id", F.explode("requires").alias("c")).filter(~F.col("c").isin(list(injected))).distinct()
    shipped = conditions.select(F.col("id").alias("c")).distinct()
    defined = source_conditions.select(F.col("id").alias("c")).distinct()
    unshipped = needs.join(shipped, "c", "left_anti")
    return all_of([
        violation(bad_lines, "unparseable-line", "package_id", "line"),
        repeated(nodes, "repeated-node", "id"), repeated(edges, "repeated-edge", "id"),
        count_differs("node-count", nodes.select("id").distinct(), source_nodes.select("id").distinct()),
        count_differs("edge-count", edges.select("id").distinct(), source_edges.select("id").distinct()),
        absent(ends, "dangling-endpoint", "id", "node", nodes, "id", "side"),
        violation(leaks, "leaves-its-package", "id"),
        violation(unshipped.join(defined, "c", "left_anti"), "unknown-condition", "id", "c"),
        violation(unshipped.join(defined, "c", "left_semi"), "unshipped-condition", "id", "c"),
    ])


def snapshot_audit(artifacts: DataFrame, contents: DataFrame, commit: str, unique: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Violations of a snapshot: artifacts (path, kind, records, sha256, chunk) declares, contents (path, commit, part, n_records, body, ids) holds.

    missing-artifact, commit-differs, part-differs (compressed ones carry a part, which must be the
    declared chunk), record-count (others), digest-differs, and repeated-id: an id that several rows of one kind hold.
    """
    got = artifacts.join(contents, "path", "left")
    here = got.filter(F.col("commit").isNotNull())
    packed = F.col("chunk").isNotNull()
    ids = here.select("kind", F.explode("ids").alias("id")).groupBy("kind", "id").agg(F.count("*").alias("n")).filter("n > 1")
    return all_of([
        violation(got.filter(F.col("commit").isNull()), "missing-artifact", "path"),
        violation(here.filter(F.col("commit") != commit), "commit-differs", "path", "commit"),
        violation(here.filter(packed & ~F.col("part").eqNullSafe(F.col("chunk"))), "part-differs", "path", "part"),
        violation(here.filter(~packed & ~F.col("n_records").eqNullSafe(F.col("records"))), "record-count", "path", "n_records"),
        violation(here.filter(F.sha2("body", 256) != F.col("sha256")), "digest-differs", "path"),
        violation(ids, "repeated-id", F.concat_ws(":", "kind", "id"), "n"),
    ])


def coverage_audit(required: DataFrame, placed: DataFrame, nodes: DataFrame, roots: DataFrame, reached: DataFrame, paths: DataFrame) -> DataFrame:
    """Violations of a coverage report.

    required (id, name): repeated ids, and names that no placement (name, formal_id) has; placements
    whose formal_id is no node (id); roots (node) that were not reached (node) and reached ones that
    are no expected root's (nodes: id, is_root); paths of check_path() (path_id, breaks) that break.
    """
    expected = nodes.filter("is_root").select(F.col("id").alias("node"))
    return all_of([
        repeated(required, "repeated-requirement", "id"),
        absent(required, "uncovered-requirement", "id", "name", placed, "name"),
        absent(placed.filter("formal_id is not null"), "placement-without-node", "name", "formal_id", nodes, "id"),
        violation(roots.join(reached.select("node").distinct(), "node", "left_anti"), "root-not-reached", "node"),
        violation(expected.join(roots.select("node"), "node", "left_anti"), "root-not-listed", "node"),
        violation(paths.filter("breaks > 0"), "broken-path", "path_id", "breaks"),
    ])


def localisation_audit(records: DataFrame, required: Sequence[str], optional: Sequence[str], mapping: DataFrame) -> DataFrame:
    """Violations of translations: records (id and the fields), mapping (id, field, level, zh).

    empty-field: a required field is blank; missing-entry: a required field, or an optional one that is
    not blank, has no mapping; no-chinese: an entry of a level other than PLAIN_LEVELS holds no CJK character.
    """
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")).alias("value"), F.lit(f in required).alias("must")) for f in [*required, *optional]])
    cells = records.select("id", F.explode(rows).alias("r")).select("id", "r.*")
    asked = cells.filter("must or value <> ''").join(mapping.withColumn("_has", F.lit(True)), ["id", "field"], "left")
    bare = asked.filter(F.col("_has") & ~F.col("level").isin(*PLAIN_LEVELS) & ~F.coalesce(F.col("zh"), F.lit("")).rlike(_CJK))
    return all_of([
        violation(cells.filter("must and value = ''"), "empty-field", "id", "field"),
        violation(asked.filter(F.col("_has").isNull()), "missing-entry", "id", "field"),
        violation(bare, "no-chinese", "id", F.concat_ws(":", "field", "level")),
    ])


def never_routeable(**tables: DataFrame) -> DataFrame:
    """Violations of the rule that evidence (id, routeable) is never routeable; a null is one too."""
    return all_of([violation(t.filter(~F.col("routeable").eqNullSafe(F.lit(False))), "routeable-evidence", "id", F.lit(name)) for name, t in tables.items()])


def holds_for_all(df: DataFrame, keys, condition: Column) -> DataFrame:
    """(keys, holds): whether the condition holds for all rows of each key; nulls do not fulfil it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("holds"))


def same_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(left_in_right, right_in_left, equal): whether the sets of keys contain each other; one row."""
    a, b = (t.select(key).distinct() for t in (left, right))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full")
    got = both.agg(F.count_if(F.col("_b").isNull()).alias("l"), F.count_if(F.col("_a").isNull()).alias("r"))
    return got.select((F.col("l") == 0).alias("left_in_right"), (F.col("r") == 0).alias("right_in_left"), ((F.col("l") == 0) & (F.col("r") == 0)).alias("equal"))
