"""Queries for what is indexed, scanned by ranges or enumerated by levels, with the SQL they must equal.

The graph S has suppliers as nodes; a supplier leads to the suppliers whose lines most often follow its own in an
order: the first of them, and for even suppliers the second too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators import cfg, grams, reachability, scans
from wayfold.plans.evidence import _INS
from wayfold.plans.workload import _g, _instructions, _reach_sql, _t, query
from wayfold.storage import delete_at_end, materialize, shared_dir

# --- reachability --------------------------------------------------------------------------------

S_SQL = """line AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS dst FROM lineitem),
n AS (SELECT src, dst, count(*) AS k FROM line WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
s AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k DESC, dst) AS r FROM n) WHERE r <= 2 - src % 2)"""
_CLOSURE = f"WITH RECURSIVE {S_SQL}, p(a, b) AS (SELECT a, a FROM (SELECT src AS a FROM s UNION SELECT dst FROM s) UNION SELECT p.a, s.dst FROM p JOIN s ON s.src = p.b)"


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    line = _t(spark, sf_dir, "lineitem").withColumn("dst", F.lead("l_suppkey").over(order)).select(F.col("l_suppkey").alias("src"), "dst")
    n = line.filter("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("k"))
    ranked = n.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("k"), "dst")))
    # the plain limit lets Spark drop what is behind a supplier's second before it shuffles
    return materialize(ranked.filter("r <= 2").filter("r <= 2 - src % 2").select("src", "dst"), "follows")


@query(f"{_CLOSURE} SELECT p.a AS id, min(p.b) AS scc FROM p JOIN p q ON q.a = p.b AND q.b = p.a GROUP BY 1")
def scc_labels(spark, sf_dir):
    return reachability.scc_labels(follows(spark, sf_dir))


@query(f"{_CLOSURE}, c AS (SELECT p.a AS id, min(p.b) AS scc FROM p JOIN p q ON q.a = p.b AND q.b = p.a GROUP BY 1) SELECT DISTINCT x.scc AS src, y.scc AS dst FROM s JOIN c x ON x.id = s.src JOIN c y ON y.id = s.dst WHERE x.scc <> y.scc")
def condensed_graph(spark, sf_dir):
    s = follows(spark, sf_dir)
    return reachability.condensed(s, materialize(reachability.scc_labels(s), "scc"))


@query(f"{_CLOSURE} SELECT s_suppkey AS a, s_suppkey * k %% (SELECT count(*) FROM supplier) AS b, EXISTS (SELECT 1 FROM p WHERE p.a = s_suppkey AND p.b = s_suppkey * k %% (SELECT count(*) FROM supplier)) OR k = 1 AND s_suppkey < (SELECT count(*) FROM supplier) AS reaches FROM supplier, (VALUES (1), (3), (7), (10)) z(k)".replace("%%", "%"))
def reach_by_labels(spark, sf_dir):
    """Whether each supplier reaches the one at 1, 3, 7 and 10 times its key, by the index, not by a search."""
    asked, n = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a")), _t(spark, sf_dir, "supplier").count()
    pairs = asked.select("a", F.explode(F.array(*[F.col("a") * k % n for k in (1, 3, 7, 10)])).alias("b"))
    return reachability.reach_by_labels(reachability.reach_index(follows(spark, sf_dir)), pairs)


@query(_reach_sql("true"))
def closure_by_labels(spark, sf_dir):
    """The closure of the nations' graph again, all pairs answered by labels."""
    g = _g(spark, sf_dir)
    ends = g.select(F.col("src").alias("seed")).distinct()
    pairs = ends.select("seed", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("node"))
    return reachability.reach_by_labels(reachability.reach_index(g, first=4), pairs, "seed", "node").filter("reaches").select("seed", F.col("node").cast("int").alias("node"))


# --- scans by ranges -----------------------------------------------------------------------------


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN props END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def carry_forward_one_part(spark, sf_dir):
    """All events are one part, which no task sees whole."""
    e = _t(spark, sf_dir, "events").withColumns({"section": F.when(F.col("event_type") == "purchase", F.col("props")), "part": F.lit(0)})
    return scans.carry_forward(e, "section", "part", ["ts", "event_id"]).select("event_id", "section")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def carry_forward_by_ranges(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("section", F.when(F.col("event_type") == "purchase", F.col("props")))
    return scans.carry_forward(e, "section", "user_id", ["ts", "event_id"]).select("event_id", "section")


@query("SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ordinal FROM events")
def valid_ordinal_one_part(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("part", F.lit(0))
    return scans.count_before(e, F.col("event_type") != "error", "part", "event_id").select("event_id", "ordinal")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM lineitem")
def running_quantity(spark, sf_dir):
    """Three return flags hold all lines, so a part is a third of the table."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return scans.running_sum(li, F.col("q"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total")


# --- grams ---------------------------------------------------------------------------------------


@query("""SELECT doc_id, word FROM documents JOIN (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{8,}')) AS word FROM benchmark) ON contains(text, word)""")
def contained_words(spark, sf_dir):
    """Documents with the long words of the benchmark that their texts hold anywhere; there is no key to join on."""
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), 0)).alias("word")).distinct()
    return grams.contains_pairs(words, _t(spark, sf_dir, "documents").select("doc_id", "text"), "word", "text", size=8).select("doc_id", "word")


@query("""SELECT s AS supplier, c AS customer FROM (SELECT s_suppkey AS s, c_custkey AS c, count(*) OVER (PARTITION BY s_suppkey) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey AND contains(c_name, CAST(s_suppkey AS VARCHAR))) WHERE n = 1""")
def contained_once(spark, sf_dir):
    """Suppliers whose number stands in the name of just one customer of their nation."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").cast("string").alias("digits"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"), "c_name")
    return grams.contained_once(s, c, "digits", "c_name", "supplier", on=["nation"]).select("supplier", "customer")


def _part_index(spark, sf_dir) -> grams.SearchIndex:
    n = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"), F.col("p_brand").alias("region"))
    path = f"{shared_dir(spark)}/wayfold-index-{uuid.uuid4().hex}"
    grams.write_index(n, path)
    delete_at_end(spark, path)
    return grams.read_index(spark, path)


_TEXT_SQL = r"lower(CAST(p_partkey AS VARCHAR) || chr(10) || coalesce(p_name, '') || chr(10) || coalesce(p_brand, ''))"


def _search_sql(query: str, limit: int) -> str:
    return f"""WITH tok AS (SELECT DISTINCT unnest(string_split(lower('{query}'), ' ')) AS t),
al AS (SELECT lower(n_name) AS alias, ['ring', 'bolt', 'brand#1', 'cold', 'widget'][n_nationkey % 5 + 1] AS target FROM nation),
cand AS (SELECT t, t AS x FROM tok UNION SELECT t, target FROM tok JOIN al ON alias = t OR len(t) >= 2 AND len(alias) >= 2 AND (contains(alias, t) OR contains(t, alias))),
hit AS (SELECT p_partkey FROM part JOIN cand ON contains({_TEXT_SQL}, x) GROUP BY 1 HAVING count(DISTINCT t) = (SELECT count(*) FROM tok))
SELECT p_partkey, (CASE WHEN contains(lower(p_name), lower('{query}')) THEN 4 ELSE 0 END) + (CASE WHEN contains(CAST(p_partkey AS VARCHAR), lower('{query}')) THEN 3 ELSE 0 END)
  + (CASE WHEN contains(lower(p_brand), lower('{query}')) THEN 1 ELSE 0 END) AS score FROM part JOIN hit USING (p_partkey) ORDER BY score DESC, p_name, p_partkey LIMIT {limit}"""


def _aliases(spark, sf_dir) -> DataFrame:
    target = F.array(*[F.lit(x) for x in ("ring", "bolt", "brand#1", "cold", "widget")])
    return _t(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.get(target, F.col("n_nationkey") % 5).alias("target"))


@query(_search_sql("Ring", 100))
def search_by_index(spark, sf_dir):
    """A top-k report: the hundred best matches, from the index."""
    return grams.indexed_search(_part_index(spark, sf_dir), "Ring", _aliases(spark, sf_dir), 100).select(F.col("id").alias("p_partkey"), "score")


@query(_search_sql("NATION_1 1 Widget", 1_000_000_000))
def search_by_index_aliases(spark, sf_dir):
    """Three tokens, one of a single character and one with a dozen alias targets; all matches."""
    return grams.indexed_search(_part_index(spark, sf_dir), "NATION_1 1 Widget", _aliases(spark, sf_dir), limit=None).select(F.col("id").alias("p_partkey"), "score")


@query(f"SELECT p_partkey FROM part WHERE contains({_TEXT_SQL}, 'd wi')")
def text_filter_by_index(spark, sf_dir):
    return grams.indexed_text_filter(_part_index(spark, sf_dir), "D Wi").select(F.col("id").alias("p_partkey"))


# --- paths ---------------------------------------------------------------------------------------

#: All simple paths of each event, instruction by instruction; o orders the branches of one.
_PATHS = f"""WITH RECURSIVE {_INS}, way AS (
SELECT x.ev, x.i, 0 AS o, pos AS target, 'condition_true' AS taken FROM ins x JOIN lb ON lb.ev = x.ev AND lb.lab = x.lab WHERE k = 0 UNION ALL SELECT ev, i, 1, i + 1, 'condition_false' FROM ins WHERE k = 0 AND i < last
UNION ALL SELECT ev, i, 0, i + 2, 'condition_true_skip' FROM ins WHERE k = 1 AND i + 2 <= last UNION ALL SELECT ev, i, 1, i + 1, 'condition_false_fallthrough' FROM ins WHERE k = 1 AND i < last
UNION ALL SELECT ev, i, 0, i + 1, 'end_if_fallthrough' FROM ins WHERE k = 3 AND i < last UNION ALL SELECT ev, i, 0, i + 1, NULL FROM ins WHERE k NOT IN (0, 1, 3) AND i < last),
more AS (SELECT *, max(o) OVER (PARTITION BY ev, i) > o AS later FROM way),
goal AS (SELECT ev, max(i) AS goal FROM ins GROUP BY 1),
p(ev, goal, here, key, trace, seen, later) AS (
  SELECT ev, goal, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), false FROM goal
  UNION ALL SELECT p.ev, p.goal, w.target, list_append(p.key, w.o), CASE WHEN w.taken IS NULL THEN p.trace ELSE list_append(p.trace, w.i || ':' || w.taken) END, list_append(p.seen, p.here), p.later OR w.later
  FROM p JOIN more w ON w.ev = p.ev AND w.i = p.here WHERE p.here <> p.goal AND NOT list_contains(p.seen, p.here)),
found AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY key) - 1 AS path FROM p WHERE here = goal),
cut AS (SELECT ev, min(key) AS key FROM p WHERE here <> goal AND list_contains(seen, here) GROUP BY 1),
told AS (SELECT ev, count(*) AS n, max(key) FILTER (WHERE path = 31) AS last, bool_or(later) FILTER (WHERE path = 31) AS later FROM found GROUP BY 1),
paths AS (SELECT g.ev, g.goal, f.path, coalesce(f.trace, []) AS trace, CASE WHEN n >= 32 THEN coalesce(c.key < told.last, false) OR told.later ELSE c.key IS NOT NULL END AS truncated
  FROM goal g LEFT JOIN told ON told.ev = g.ev LEFT JOIN cut c ON c.ev = g.ev LEFT JOIN found f ON f.ev = g.ev AND f.path < 32)"""


@query(f"{_PATHS} SELECT ev AS event_id, goal AS target_index, path, array_to_string(trace, ',') AS trace, truncated FROM paths")
def cfg_paths(spark, sf_dir):
    """The first paths, depth first, to the last instruction of each event."""
    return _paths(spark, sf_dir).select("event_id", "target_index", "path", F.array_join("trace", ",").alias("trace"), "truncated")


def _paths(spark, sf_dir) -> DataFrame:
    i = materialize(_instructions(spark, sf_dir), "instructions")
    targets = i.groupBy("map_id", "event_id").agg(F.max("index").alias("target_index"))
    return cfg.bounded_paths(cfg.successors(i), targets)


@query(f"""{_PATHS}, e AS (SELECT list_transform(trace, lambda t: struct_pack(i := CAST(split_part(t, ':', 1) AS INTEGER),
  truth := CASE WHEN split_part(t, ':', 2) IN ('condition_true', 'condition_true_skip') THEN 'true' ELSE 'false' END)) AS terms FROM paths WHERE path IS NOT NULL),
j AS (SELECT '{{"kind":"all_of","terms":[' || array_to_string(list_transform(terms, lambda t: '{{"index":' || t.i || ',"truth":' || t.truth || '}}'), ',') || ']}}' AS body FROM e)
SELECT left(sha256(body), 16) AS expression_id, 'all_of' AS kind, count(*) AS occurrences, 0 AS unresolved FROM j GROUP BY body""")
def guard_expressions(spark, sf_dir):
    return cfg.guard_expressions(_paths(spark, sf_dir)).select("expression_id", "kind", "occurrences", "unresolved")
