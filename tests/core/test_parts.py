import base64
import struct
import zlib

from pyspark.sql import functions as F

from wayfold.functions import keys as K
from wayfold.functions import text as X
from wayfold.operators import catalog, cfg, layout, localise, search
from wayfold.operators import relational as R
from wayfold.sources import blobs


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_keys(spark):
    lit = F.lit
    assert one(spark, K.map_key(lit(10), lit(1), lit(0))) == "m10_01_00" and one(spark, K.map_key(lit(10), lit(None), lit(0))) is None
    key, wild = K.bytes_key(F.array(*[lit(i) for i in (60, 255, 1, 0)]))
    assert one(spark, key) == "m60_00_01_00" and one(spark, wild) is True
    assert one(spark, K.bytes_key(F.array(*[lit(i) for i in (300, 0, 0, 0)]))[0]) is None
    assert one(spark, K.packed_key(lit((60 << 24) | (42 << 16) | (36 << 8) | 255))) == "m60_42_36_FF"
    assert one(spark, K.digits_key(lit(60423600))) == "m60_42_36_00" and one(spark, K.digits_key(lit(9001001))) is None and one(spark, K.digits_key(lit(9001001), True)) == "m09_00_10_01"
    assert one(spark, K.model_name(lit(42))) == "h000042" and one(spark, K.model_id(lit("H000042"))) == 42 and one(spark, K.model_id(lit("a_000123.hkx"))) == 123
    assert one(spark, K.under(lit("m10_00"), "m10_0")) is False and one(spark, K.under(lit("m10_0_1"), "m10_0")) is True
    assert one(spark, K.position(lit(1), lit("2"), lit(None))) is None
    assert [K.clamp_limit(v) for v in ("0", "-1", 5000, "abc", None, "7")] == [1, 1, 1000, 100, 100, 7]


def test_text(spark):
    t = lambda f, s: one(spark, f(F.lit(s)))
    assert t(X.collapse_lower, "  A \n b ") == "a b" and t(X.plain_label, "The (old) Gate-2") == "thegate2"
    assert t(X.wordset_key, "The Lord of the Rings, a lord") == "a lord lord rings"
    assert t(X.without_punctuation, " Ranni's  Half-Way: \"x\"; ") == "rannis half-way x"
    assert [t(X.merge_plural, s) for s in ("The  Virgins", "Two women", "Beasts", "cats", "", "Men")] == ["The virgin", "Two woman", "beast", "cats", "", "man"]
    assert [t(X.end_side, s) for s in ("レバー（下） {3}", "Lever lower", "LEVER TOP {1}", "扉上側", "扉")] == [None, "lower", "upper", "upper", None]
    assert [t(X.side_free_label, s) for s in ("レバー 下側", "Ｌｅｖｅｒ Top {2}", "lever bottom")] == ["レバー", "lever", "lever"]
    assert t(X.has_cjk, "a中") is True and t(X.nfkc, "ｱ") == "ア" and t(X.casefold, "Straße") == "strasse" and t(X.slug, " Ab--c d!") == "ab-c-d"
    main, inner = X.bracket_parts(F.lit("Gate (north)"))
    assert one(spark, main) == "Gate" and one(spark, inner) == "north" and one(spark, X.bracket_parts(F.lit("Gate"))[1]) is None
    assert one(spark, X.reverse_bits(F.lit(6))) == 96 and one(spark, X.align(F.lit(5), 4)) == 8
    assert one(spark, X.content_id(F.struct(F.lit(1).alias("a")))) == one(spark, F.substring(F.sha2(F.lit('{"a":1}'), 256), 1, 16))


def test_blobs(spark):
    data = base64.b64encode(zlib.compress('[[1,"a"],[2,"ü"]]'.encode())).decode()
    rows = [("k", 2, 2, data[7:]), ("k", 1, 2, data[:7]), ("bad", 1, 3, "x"), ("bad", 3, 3, "y")]
    good, failed = blobs.decode_chunks(spark.createDataFrame(rows, "key string, part int, parts int, chunk string"))
    got = blobs.rows_with_index(good, "text", "array<string>").orderBy("source_index").collect()
    assert [(r.key, r.source_index, r.row) for r in got] == [("k", 0, ["1", "a"]), ("k", 1, ["2", "ü"])] and [r.key for r in failed.collect()] == ["bad"]
    rows = spark.createDataFrame([(["1", "2"],), (["1"],)], "row array<string>")
    assert [tuple(r) for r in blobs.positional_rows(rows, "row", ["a", "b"]).collect()] == [("1", "2")]
    text = spark.createDataFrame([("d", i, s) for i, s in enumerate(["# A", "- x", "## B", "- y", "# C", "- z"])], "doc string, pos int, value string")
    got = blobs.sectioned(text, "value", "doc", "pos", [r"^# (.*)$", r"^## (.*)$"], r"^- (.*)$").orderBy("pos").collect()
    assert [(r.section_0, r.section_1, r.item) for r in got] == [("A", None, "x"), ("A", "B", "y"), ("C", None, "z")]
    assert blobs.delimited(spark.createDataFrame([("1,a,b,c",), ("x,a,b",), ("2,a",)], "v string"), "v", 3).first().parts == ["1", "a", "b,c"]


def test_bytes(spark):
    raw = struct.pack("<BxhI", 7, -2, 9) + struct.pack("<f", 1.5)
    ins = spark.createDataFrame([(1, 1, raw.hex()), (1, 1, "07"), (2, 2, "")], "bank int, opcode int, args_hex string")
    defs = spark.createDataFrame([(1, 1, ["a", "b", "c", "d"], [0, 4, 2, 6])], "bank int, opcode int, names array<string>, kinds array<int>")
    got = blobs.decode_arguments(ins, defs).collect()
    by = {r.args_hex: r.decoded for r in got}
    assert [a.value for a in by[raw.hex()].args] == [7, -2, 9, 1.5] and by["07"].error.startswith("argument 1") and by[""].error == "no definition"
    calls = spark.createDataFrame([(1, 10, "aabbcc")], "bank int, call_id int, args_hex string")
    moves = ins.limit(1).withColumn("moves", F.array(F.struct(F.lit(0).alias("target"), F.lit(1).alias("source"), F.lit(2).alias("size"))))
    assert blobs.substitute(moves, calls, "bank").first().args_hex[:4] == "bbcc"
    # version 2: a group of ids 5 to 6, 64-bit offsets
    texts = "Hé\0".encode("utf-16-le")
    head = struct.pack("<BBBBIB3xiiiQQ", 0, 0, 2, 0, 0, 1, 1, 2, 255, 56, 0) + struct.pack("<4i", 0, 5, 6, 0)
    table = head + struct.pack("<2Q", len(head) + 16, 0) + texts
    assert len(head) == 56 and blobs.string_table(table) == [(5, "Hé"), (6, "")]
    files = spark.createDataFrame([("t", bytearray(table)), ("b", bytearray(b"\0\0"))], "path string, content binary")
    assert sorted((r.path, r.id, r.text, r.error is None) for r in blobs.read_string_tables(files).collect() if r.path == "t") == [("t", 5, "Hé", True), ("t", 6, "", True)]


def test_documents(spark, tmp_path):
    (tmp_path / "m1.json").write_text('{"a": [1, 2]}')
    (tmp_path / "m2.json").write_text("{broken")
    (tmp_path / "x.txt").write_text("no")
    good, failed = blobs.scan_documents(spark, str(tmp_path), r"^(m[0-9]+)\.json$")
    assert [r.key for r in good.collect()] == ["m1"] and [r.key for r in failed.collect()] == ["m2"]
    assert blobs.read_document(spark, str(tmp_path / "m1.json"), "a array<int>").first().a == [1, 2]


def test_relational_edges(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), (None, 3, "b")], "k string, n int, v string")
    assert R.resolve_unique(df, df.select("k", F.col("n").alias("p")), "k", "p").filter("k is null").first().match_status == "not_found"
    assert one(spark, R.common_to_all(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))))) == [2]
    assert R.coverage(df.limit(0), df, "n").first().fraction == 0.0
    assert R.axis_bounds(spark.createDataFrame([("g", "x"), ("g", "2.5")], "k string, a string"), "k", ["a"]).first().max_a == 2.5
    rules = spark.createDataFrame([], "p string, y string")
    assert R.longest_prefix(df, "v", rules, "p", "y").count() == 3


def test_catalog_and_search(spark):
    df = spark.createDataFrame([(1, "Gate", "A", "m10_00", ["f1"], False), (2, "gate two", None, "m10_01", [], True), (3, "Bridge", "B", "m1", None, None)], "id int, label string, region string, key string, formal_candidates array<string>, dummy boolean")
    spec = catalog.CatalogSpec(text=["label", "region"], below={"map": "key"}, member={"formal_id": "formal_candidates"}, flag=("include_dummy", "dummy"), order=["id"])
    ids = lambda **p: [r.id for r in catalog.matching(df, spec, p).orderBy("id").collect()]
    assert ids() == [1, 3] and ids(include_dummy="yes", q="GATE") == [1, 2] and ids(map="m10", include_dummy="1") == [1, 2] and ids(map="m10_0") == [] and ids(formal_id="f1") == [1]
    page, total = catalog.catalog_query(df, spec, {"include_dummy": "1", "limit": "2"})
    assert page.count() == 2 and tuple(total.first()) == (2, 3)
    bound = catalog.bind_identity(df, spark.createDataFrame([(1, "x", "old", 1), (1, "y", "new", 2)], "id int, formal_id string, binding_basis string, seq int"), "id")
    assert bound.filter("id = 1").first().formal_candidates == ["f1", "y"] and bound.filter("id = 3").first().formal_binding is None and bound.filter("id = 1").first().formal_binding.routeable is False
    nodes = df.withColumn("kind", F.lit("k"))
    names = spark.createDataFrame([("门", "gate")], "alias string, target string")
    assert [(r.id, r.score) for r in search.search(nodes, "gate").collect()] == [(1, 4), (2, 4)]
    assert [r.id for r in search.search(nodes, "门 two", names).collect()] == [2] and [r.id for r in search.search(nodes, "gate two", names).collect()] == [2]
    assert [r.id for r in search.search(nodes, "门", names).collect()] == [1, 2]


def test_localise(spark):
    known = localise.dictionary(spark.createDataFrame([("Stone Gate", "石门"), ("North", "北"), ("Ruby man", "红")], "source_text string, target_text string"))
    words = spark.createDataFrame([(1, "stone gate"), (2, "gate of Stone"), (3, "Ruby Men"), (4, "none")], "k int, x string")
    assert [(r.level, r.targets) for r in localise.lookup(words, "x", known).orderBy("k").collect()] == [("norm", ["石门"]), ("wordset", ["石门"]), ("singular", ["红"]), (None, None)]
    got = localise.split_match(spark.createDataFrame([(1, "Stone Gate (North)"), (2, "North, East")], "k int, x string"), "k", "x", known).orderBy("k").collect()
    assert (got[0].joined, got[0].complete, got[1].complete) == ("石门 北", True, False)
    head = localise.longest_head(spark.createDataFrame([(1, "Stone Gate tower")], "k int, x string"), "k", "x", known).first()
    assert (head.head, head["rest"], head.targets) == ("stone gate", "tower", ["石门"])


def test_control_flow(spark):
    ins = [("m", 1, 0, "GOTO IF X", 7, None), ("m", 1, 1, "SKIP IF Y", None, 1), ("m", 1, 2, "END IF Z", None, None), ("m", 1, 3, "Label 7", None, None), ("m", 1, 4, "SET", None, None)]
    b = cfg.successors(spark.createDataFrame(ins, "map_id string, event_id long, index int, name string, label int, skip int"))
    goal = spark.createDataFrame([("m", 1, 4), ("m", 1, 9)], "map_id string, event_id long, target_index int")
    got = cfg.bounded_paths(b, goal).orderBy("target_index", "path").collect()
    assert [r.trace for r in got] == [["0:condition_true"], ["0:condition_false", "1:condition_true_skip"], ["0:condition_false", "1:condition_false_fallthrough", "2:end_if_fallthrough"], []]
    assert got[3].path is None and not got[3].truncated
    assert cfg.bounded_paths(b, goal, most_paths=1).filter("target_index = 4").first().truncated
    assert cfg.guard_expressions(cfg.bounded_paths(b, goal)).count() == 3


def test_layout(spark):
    df = spark.createDataFrame([("g", "a", 0.0, 0.0), ("g", "b", 1.0, 0.0)], "g string, id string, x double, y double")
    out = layout.repel(df, "g", 10.0).orderBy("id").collect()
    assert abs(out[1].x - out[0].x - 10) < 1e-6
    v = layout.viewport(df).first()
    assert abs(v.x + 0.08) < 1e-9 and abs(v.width - 1.16) < 1e-9 and tuple(layout.zoom_to_fit(df, 300.0, 300.0).first()) == (0.5, 0.0, 4.0) and layout.zoom_to_fit(df.limit(0), 1.0, 1.0).count() == 0
