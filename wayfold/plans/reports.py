"""Queries for reports, writers and bindings, with the SQL they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.functions import text as X
from wayfold.operators import catalog, graph, layout, scans
from wayfold.plans.workload import G_SQL, _g, _load, _t, nodes, query
from wayfold.sources import blobs, packages
from wayfold.storage import delete_at_end, materialize, shared_dir


@query(f"""WITH {G_SQL}, q AS (
SELECT 'node' AS kind, r_name AS package_id, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 11 = 1 GROUP BY 2
UNION ALL SELECT 'dangling-edge', r_name, count(*) FROM g JOIN nation ON n_nationkey = src JOIN region ON r_regionkey = n_regionkey WHERE dst % 7 = 3 GROUP BY 2)
SELECT r_name AS package_id, 'loaded' AS status, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_problems, coalesce(array_to_string(list_sort(list_distinct(list(kind) FILTER (WHERE kind IS NOT NULL))), ','), '') AS kinds
FROM region LEFT JOIN q ON package_id = r_name GROUP BY 1""")
def package_diagnostics(spark, sf_dir):
    got = packages.diagnostics(_load(spark, sf_dir))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.coalesce("problems.kind", F.array().cast("array<string>")))), ",")
    return got.select("package_id", "status", F.col("n_problems").cast("bigint").alias("n_problems"), kinds.alias("kinds"))


@query(f"""WITH {G_SQL}, l AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY cost) AS i, a.n_name || ' -> ' || b.n_name || CASE WHEN cnt % 2 = 0 THEN ' (one way)' ELSE '' END || ' · ' || CASE WHEN cost = 1 THEN 'walk' ELSE 'ride' END AS t
  FROM g JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst)
SELECT src, 'Route (' || count(*) || ' legs)' || chr(10) || string_agg(i || '. ' || t, chr(10) ORDER BY i) AS text FROM l GROUP BY 1""")
def route_text(spark, sf_dir):
    """Each nation's edges, cheapest first, written as if they were a route."""
    g = _g(spark, sf_dir)
    legs = F.array_sort(F.collect_list(F.struct("cost", "id", "src", "dst")))
    found = g.groupBy(F.col("src").alias("origin")).agg(F.transform(legs, lambda x: F.struct(x["id"].alias("id"), x["src"].alias("src"), x["dst"].alias("dst"))).alias("edges"))
    notes = g.select("id", (F.col("cnt") % 2 == 0).alias("one_way"), F.when(F.col("cost") == 1, "walk").otherwise("ride").alias("mode"))
    got = graph.numbered_text(found, "origin", nodes(spark, sf_dir).select("id", "label"), notes, "Route ({} legs)", " (one way)")
    return got.select(F.col("origin").alias("src"), "text")


@query("""WITH b AS (SELECT p_partkey // 3 * 3 AS k, max_by(p_brand, p_partkey) AS formal_id, max_by(p_type, p_partkey) AS binding_basis FROM part WHERE p_size < 25 GROUP BY 1)
SELECT p_partkey, CASE WHEN formal_id IS NULL OR p_partkey % 2 = 0 AND formal_id = p_brand THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand || ',' || p_brand ELSE '' END ELSE CASE WHEN p_partkey % 2 = 0 THEN p_brand || ',' || p_brand || ',' ELSE '' END || formal_id END AS candidates,
  formal_id, binding_basis, CASE WHEN formal_id IS NOT NULL THEN true END AS identity_only, CASE WHEN formal_id IS NOT NULL THEN false END AS routeable FROM part LEFT JOIN b ON k = p_partkey""")
def bound_identities(spark, sf_dir):
    """Parts with bindings of every third key; the last of a key's bindings counts, and its id is appended if it is absent."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(k.alias("key"), F.when(k % 2 == 0, F.array("p_brand", "p_brand")).alias("formal_candidates"))
    bindings = p.filter("p_size < 25").select((F.floor(k / 3) * 3).alias("key"), F.col("p_brand").alias("formal_id"), F.col("p_type").alias("binding_basis"), k.alias("seq"))
    b = F.col("formal_binding")
    return catalog.bind_identity(rows, bindings, "key").select(
        F.col("key").alias("p_partkey"), F.coalesce(F.array_join("formal_candidates", ","), F.lit("")).alias("candidates"), b["formal_id"].alias("formal_id"), b["binding_basis"].alias("binding_basis"), b["identity_only"].alias("identity_only"), b["routeable"].alias("routeable"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'lower' WHEN 1 THEN 'upper' WHEN 2 THEN NULL WHEN 3 THEN 'upper' ELSE 'lower' END AS side, replace(p_name, ' ', '') AS label FROM part""")
def mechanism_sides(spark, sf_dir):
    """Names with full-width letters, numbers, brackets and sides at their end: side and label without it."""
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    name = (
        F.when(k == 0, F.concat(n, F.lit(" Lower {12}"))).when(k == 1, F.concat(F.upper(n), F.lit("上側 "))).when(k == 2, F.concat(n, F.lit("（下） {3}")))
        .when(k == 3, F.concat(F.initcap(n), F.lit(" ＴＯＰ"))).otherwise(F.concat(n, F.lit(" 下")))
    )
    return _t(spark, sf_dir, "part").select("p_partkey", X.end_side(name).alias("side"), X.side_free_label(name).alias("label"))


@query(f"""WITH {G_SQL}, r AS (SELECT r_name AS package_id, 0 AS k, '' AS id, 'header' AS type FROM region
UNION ALL SELECT r_name, 1, CAST(n_nationkey AS VARCHAR), 'node' FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name, 2, src || '-' || dst, 'edge' FROM g JOIN nation ON n_nationkey = src JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT DISTINCT r_name, 3, need, 'condition' FROM g JOIN nation ON n_nationkey = src JOIN region ON r_regionkey = n_regionkey WHERE need IS NOT NULL)
SELECT package_id, CAST(row_number() OVER (PARTITION BY package_id ORDER BY k, id) AS INTEGER) AS line, type, id FROM r""")
def written_packages(spark, sf_dir):
    """Packages written as lines in order, in files of which a package may have several, and read again."""
    n = nodes(spark, sf_dir).select("package_id", F.col("id").cast("string").alias("id"), "label")
    home = n.select("package_id", F.col("id").cast("int").alias("src"))
    e = _g(spark, sf_dir).join(home, "src").select("package_id", "id", "src", "dst", "requires")
    conditions = _t(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.col("r_name").alias("label"))
    path = f"{shared_dir(spark)}/wayfold-packages-{uuid.uuid4().hex}"
    packages.write_packages(n, e, conditions, "package@1", path)
    delete_at_end(spark, path)
    lines = packages.written_lines(spark, path).select("package_id", "line", F.try_parse_json("raw").alias("v"))
    at = lambda p: F.try_variant_get("v", p, "string")
    return lines.select("package_id", "line", F.coalesce(at("$.type"), F.lit("header")).alias("type"), F.coalesce(at("$.record.id"), F.lit("")).alias("id"))


def _little(n, size: int = 4):
    """A number's bytes, the least first."""
    digits = F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)]))


@query("SELECT p_brand AS path, 100 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS id, p_name || '中' AS text FROM part UNION ALL SELECT 'broken', NULL, NULL FROM (SELECT 1 FROM part LIMIT 1)")
def string_tables(spark, sf_dir):
    """A binary table of texts for each brand, one group of ids each, and one file that is cut short."""
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("key"), F.encode(F.concat("p_name", F.lit("中\0")), "UTF-16LE").alias("t"))
    placed = scans.running_sum(p, F.octet_length("t"), "path", "key", "end").select("path", "key", "t", (F.col("end") - F.octet_length("t")).alias("at"))
    n = F.count("*").over(W.partitionBy("path"))
    # 20 bytes of header, three numbers, a group of 12 bytes, an offset for each text, the texts
    texts = placed.withColumn("start", _little(F.col("at") + 44 + 4 * n)).groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("key", "start", "t"))).alias("rows"))
    # joined as one text of hexadecimal digits, each of them written once
    joined = lambda c: F.unhex(F.array_join(F.transform("rows", lambda x: F.hex(x[c])), ""))
    header = F.concat(F.unhex(F.lit("000001000000000001000000")), _little(F.lit(1)), _little(F.col("n")))
    made = F.concat(header, _little(F.lit(44)), _little(F.lit(0)), _little(F.lit(0)), _little(F.lit(101)), _little(100 + F.col("n")))
    made = F.concat(made, F.unhex(F.lit("00000000")))  # the table may stand anywhere
    files = materialize(texts.select("path", F.concat(made, joined("start"), joined("t")).alias("content")), "tables")
    cut = files.orderBy("path").limit(1).select(F.lit("broken").alias("path"), F.substring("content", 1, 15).alias("content"))
    return blobs.read_string_tables(files.union(cut)).select("path", "id", "text")


@query("""WITH b AS (SELECT 'r' || n_regionkey AS region, CAST(min(n_nationkey * 40) AS DOUBLE) AS x0, CAST(max(n_nationkey * 40) AS DOUBLE) AS x1, CAST(min(n_nationkey * 7 % 25 * n_regionkey) AS DOUBLE) AS y0, CAST(max(n_nationkey * 7 % 25 * n_regionkey) AS DOUBLE) AS y1 FROM nation GROUP BY 1)
SELECT region, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, greatest(0.5, least(4.0, (1000.0 - 140) / greatest(1.0, x1 - x0), (700.0 - 140) / greatest(1.0, y1 - y0))) AS zoom FROM b""")
def region_camera(spark, sf_dir):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    n = _t(spark, sf_dir, "nation").select(F.concat(F.lit("r"), r.cast("string")).alias("region"), (k * 40).alias("x"), (k * 7 % 25 * r).alias("y"))
    return layout.zoom_to_fit(n, 1000.0, 700.0, pad=70.0, least=0.5, most=4.0, by=["region"])


@query()
def repelled_places(spark, sf_dir):
    """Customers of each nation pushed apart; a sequential rule without SQL, held against one plain run in the tests."""
    k = F.col("c_custkey")
    places = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), k.alias("id"), (k * 7919 % 10007 / 10.0).alias("x"), (k * 104729 % 9973 / 10.0).alias("y"))
    return layout.repel(places, "nation", 12.0)
