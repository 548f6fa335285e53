import json
import random

import duckdb

from wayfold.llm import chat
from wayfold.llm.chat import ORACLE_SQL, ChatParams, canonical, chat_digest, format_chats, violations
from wayfold.storage import materialize

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": ["integer", "null"]}, "op": {"enum": ["x", "y"]}}, "required": ["a"], "additionalProperties": False}}


def call(i, deps=None, name="add", args=None):
    body = {"id": i, "name": name, "arguments": {"a": 1} if args is None else args} | ({"depends_on": deps} if deps else {})
    return f"<tool_call>{json.dumps(body)}</tool_call>"


def result(i, content="r"):
    return f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"


def test_schema():
    assert violations({"a": 1, "b": None, "op": "x"}, SCHEMAS["add"]) == []
    assert violations({"a": True, "op": "z", "q": 1}, SCHEMAS["add"]) == ["$.a: not integer", "$.op: not in enum", "$.q: unknown"]
    assert violations({}, SCHEMAS["add"]) == ["$.a: missing"] and violations([], SCHEMAS["add"]) == ["$: not object"]
    assert canonical({"b": [1, 2.5, None], "a": "é\n"}) == '{"a":"é\\n","b":[1,2.5,null]}'


def test_links_order_and_status(spark):
    rows = [
        (1, 0, "user", "Hi"), (1, 1, "assistant", "ok " + call("c2", ["c1"]) + call("c1")), (1, 2, "tool", result("c1") + result("c2")),
        (1, 3, "tool", result("zz") + result("c1", "again")), (1, 4, "assistant", call("c3", name="nope") + "<tool_call>{oops</tool_call>"),
        (2, 0, "tool", result("c1", "early")), (2, 1, "assistant", call("c1", args={"b": 1})), (3, 0, "assistant", call("p", ["q"]) + call("q", ["p"])), (3, 1, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as status", "1 as level")
    got = format_chats(df, ChatParams(SCHEMAS)).orderBy("conv_id", "order_turn", "level", "turn", "idx").collect()
    of = lambda c: [(r.kind, r.id, r.status) for r in got if r.conv_id == c and (r.kind != "message")]
    assert [x for x in of(1) if x[2] == "linked"] == [("call", "c1", "linked"), ("call", "c2", "linked"), ("result", "c1", "linked"), ("result", "c2", "linked")]
    assert {x for x in of(1) if x[2] != "linked"} == {("result", "zz", "orphan"), ("result", "c1", "duplicate"), ("call", "c3", "unanswered"), ("call", None, "bad")}
    assert of(2) == [("call", "c1", "linked"), ("result", "c1", "linked")]
    assert {x[2] for x in of(3)} == {"cyclic"}
    errors = {(r.conv_id, r.kind, r.id): list(r.errors) for r in got}
    assert errors[1, "call", "c1"] == [] and errors[2, "call", "c1"] == ["$.a: missing"] and errors[1, "call", "c3"] == ["$: unknown tool"]
    assert [r.json for r in got if r.kind == "message" and r.conv_id == 1][:2] == ['{"content":"Hi","kind":"message","role":"user","turn":0}', '{"content":"ok","kind":"message","role":"assistant","turn":1}']
    assert format_chats(df.limit(0)).count() == 0


def test_repeats(spark):
    df = spark.createDataFrame([(1, 0, "assistant", call("a"))] * 2, "conv_id long, turn long, role string, text string")
    got = format_chats(df, ChatParams(SCHEMAS)).collect()
    assert sorted((r.kind, r.status) for r in got) == [("call", "duplicate"), ("call", "unanswered"), ("message", "ok"), ("message", "ok")]


def test_long_chain_is_not_cyclic(spark):
    n = 54
    text = "".join(call(f"c{i}", [f"c{i - 1}"] if i else None) for i in range(n))
    df = spark.createDataFrame([(1, 0, "assistant", text + call("p", ["q"]) + call("q", ["p"]))], "conv_id long, turn long, role string, text string")
    got = {r.id: (r.status, r.level) for r in format_chats(df, ChatParams(SCHEMAS)).filter("kind = 'call'").collect()}
    assert got == {f"c{i}": ("unanswered", 2 * i + 1) for i in range(n)} | {"p": ("cyclic", None), "q": ("cyclic", None)}


def test_bodies_that_python_or_utf8_cannot_hold(spark):
    deep = '{"id": "d", "name": "add", "arguments": ' + "[" * 100_000 + "]" * 100_000 + "}"
    rows = [(1, 0, "assistant", f"<tool_call>{deep}</tool_call>"), (2, 0, "assistant", '<tool_call>{"id": "s", "name": "add", "arguments": {"\\ud800": "\\udfff"}}</tool_call>')]
    rows += [(3, 0, "assistant", '<tool_call>{"id": "n", "name": "add", "arguments": {"a": NaN}}</tool_call>'), (4, 0, "assistant", '<tool_call>{"id": "i", "name": "add", "arguments": {"a": 1e999}}</tool_call>')]
    rows += [(None, 0, "assistant", call("z")), (None, 1, "tool", result("z")), (5, 0, "user", "long " * 200_000)]
    got = {(r.conv_id, r.turn): r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ChatParams(SCHEMAS)).collect() if r.kind != "message" or r.conv_id == 5}
    assert all(list(got[k, 0].errors) == ["$: not a JSON object"] for k in (1, 3, 4))
    assert list(got[2, 0].errors) == ["$.a: missing", "$.\\ud800: unknown"] and '{"\\ud800":"\\udfff"}' in got[2, 0].json
    assert got[None, 1].status == "orphan" and len(json.loads(got[5, 0].json)["content"]) == 999_999


def test_calls_made_from_turns_same_as_sql(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"{'é ' * (t % 3)}word{c} says \"{t}\"\n") for c in range(33) for t in range(2 + c % 9)]
    rows += [(40, 0, None, None), (41, 0, "system", ""), (42, 1, "assistant", "a"), (42, 1, "assistant", "a"), (-3, 0, "user", "q"), (-3, 1, "assistant", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_digest(df)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "int64", "turn": "int64"}))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {r.status for r in got.select("status").distinct().collect()} == {"ok", "linked", "orphan", "duplicate", "cyclic", "unanswered", "bad"}


def test_calls_of_a_conversation_take_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"c{i}" for i in range(40)]
    rows = [(1, t, "assistant", call(f"c{t}", [f"c{t - 1}"] if t else None)) for t in range(20)]
    rows += [(k, t, "assistant", call(rng.choice(names), rng.sample([*names, "gone"], rng.choice((0, 0, 1, 2))))) for k in range(2, 14) for t in rng.sample(range(90), 30)]
    df = materialize(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    written = []
    monkeypatch.setattr(chat, "materialize", lambda df, name="table": (written.append(name), materialize(df, name))[1])
    told = lambda n: sorted(map(str, format_chats(df, ChatParams(SCHEMAS, n)).drop("json").collect()))
    whole = told(2_000)
    assert len(written) == 5  # before, two tables for each call of the chain
    assert whole == told(25) and any("level=39" in x for x in whole) and any("cyclic" in x for x in whole)
