"""Fault injection: a bad record must cost itself alone."""

import json

from wayfold.operators import graph
from wayfold.sources import packages

SCHEMA = "package@1"


def lines(*records, head=True):
    out = [json.dumps({"schema": SCHEMA, "package": {"id": "p"}})] if head else []
    return "\n".join(out + [r if isinstance(r, str) else json.dumps(r) for r in records])


def node(i, **k):
    return {"type": "node", "record": {"id": i, "label": i, **k}}


def edge(i, a, b, **k):
    return {"type": "edge", "record": {"id": i, "from": a, "to": b, "cost": 1, "risk": 0, "requires": [], **k}}


def load(spark, texts, extra=None):
    files = spark.createDataFrame([(p, i, t) for i, (p, t) in enumerate(texts.items())], "package_id string, pos int, text string")
    manifest = spark.createDataFrame([("p",), ("q",), ("never",)], "id string")
    late = None if extra is None else spark.createDataFrame([(c, c) for c in extra], "id string, label string")
    return packages.load_packages(files, manifest, SCHEMA, late)


def kinds(g):
    return sorted((r.kind, r.package_id) for r in g.quarantine.collect())


def test_isolation(spark):
    text = lines(node("a"), node("b"), node(" "), node("a", label="later"), "not json", '{"type":"node"}', "", edge("e1", "a", "b"), edge("e1", "b", "a"), edge("e2", "a", "gone"),
                 edge("e3", "", "b"), {"type": "edge", "record": {"from": "b", "to": "a"}}, {"type": "condition", "record": {"id": "c"}}, {"type": "condition", "record": {"id": "c"}}, {"type": "other", "record": {}})
    g = load(spark, {"p": text, "q": lines(node("z"), head=False), "undeclared": lines(node("y"))})
    assert kinds(g) == [("dangling-edge", "p"), ("edge", "p"), ("edge", "p"), ("node", "p"), ("node", "p"), ("record-line", "p"), ("record-line", "p")]
    assert {r.id: r.label for r in g.nodes.collect()} == {"a": "a", "b": "b"}
    made = {r.id: r for r in g.edges.collect()}
    assert set(made) == {"e1", "p:b:a:2"} and made["p:b:a:2"].cost == 1.0 and len(made["p:b:a:2"].degraded) == 3
    assert {r.package_id: (r.status, r.node_count, r.edge_count, r.quarantined_count) for r in g.packages.collect()} == {"p": ("loaded", 2, 2, 1), "q": ("failed", 0, 0, 0), "never": ("pending", 0, 0, 0)}
    assert g.conditions.count() == 1 and {r.line for r in g.quarantine.filter("kind = 'record-line'").collect()} == {6, 7}
    assert packages.diagnostics(g).filter("package_id = 'p'").first().n_problems == 7


def test_unknown_condition_blocks_until_registered(spark):
    text = {"p": lines(node("a"), node("b"), edge("e1", "a", "b", requires=["late"]))}
    g = load(spark, text)
    assert g.edges.first().condition_unknown == ["late"] and graph.route(g.nodes, g.edges, "a", "b", ["late"]).isEmpty()
    got = [(r.condition, r.defined) for r in graph.explain_blocked(g.nodes, g.edges, g.conditions, "a", "b").collect()]
    assert got == [("late", False)]
    g = load(spark, text, ["late"])
    assert graph.route(g.nodes, g.edges, "a", "b").isEmpty() and graph.route(g.nodes, g.edges, "a", "b", ["late"]).first().score == 1.0


def test_round_trip_and_missing_files(spark, tmp_path):
    g = load(spark, {"p": lines(node("a"), node("b"), edge("e1", "a", "b", requires=["c"]), {"type": "condition", "record": {"id": "c", "label": "C"}})})
    packages.write_packages(g.nodes.select("package_id", "id", "label"), g.edges.select("package_id", "id", "src", "dst", "requires"), g.conditions, SCHEMA, str(tmp_path / "out"))
    rows = spark.read.text(str(tmp_path / "out")).collect()
    assert len(rows) == 5 and json.loads(rows[0].value)["schema"] == SCHEMA
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.jsonl").write_bytes(lines(node("a"), "", "last").replace("\n", "\r\n").encode())
    manifest = spark.createDataFrame([("p", "p.jsonl", 0), ("q", "q.jsonl", 1), ("Bad id", "b.jsonl", 2)], "id string, path string, pos int")
    got, failed = packages.read_packages(spark, manifest, str(tmp_path / "in"))
    assert sorted((r.package_id, r.line, r.raw) for r in got.collect())[1:] == [("p", 2, json.dumps(node("a"))), ("p", 3, ""), ("p", 4, "last")]
    assert packages.load_packages(got, manifest, SCHEMA).nodes.first().id == "a"
    assert sorted(r.package_id for r in failed.collect()) == ["Bad id", "q"]


def test_empty(spark):
    g = load(spark, {"p": lines()})
    assert g.nodes.isEmpty() and g.edges.isEmpty() and graph.explain_blocked(g.nodes, g.edges, g.conditions, "a", "b").first().category == "no-data"


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    (tmp_path / "in" / "p.jsonl").write_text("\n".join(want))
    manifest = spark.createDataFrame([("p", "p.jsonl", 0)], "id string, path string, pos int")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = packages.read_packages(spark, manifest, str(tmp_path / "in"))[0].orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.raw for r in got] == want and [r.line for r in got] == list(range(1, len(want) + 1))
