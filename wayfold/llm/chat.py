"""Operator 4: chat formatting with linked tool calls.

Messages carry calls and results as tagged JSON: <tool_call>{"id", "name", "arguments",
"depends_on"?}</tool_call> and <tool_result>{"id", "content"}</tool_result>. Calls and results are
hash-joined by (conversation, id), put into topological order, validated against the tools'
schemas and serialised as canonical JSON, one row for each message, call and result, so that no
conversation has to fit into one task.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.storage import discard, materialize


@dataclass(frozen=True)
class ChatParams:
    """schemas: JSON Schema (type, properties, required, enum, items, additionalProperties) by tool
    name. Calls of a conversation with at most whole_calls calls and dependencies are ordered in one
    row, those of larger ones by rounds; the number changes no result.
    """

    schemas: dict = field(default_factory=dict, hash=False)
    whole_calls: int = 2_000


_LONE = re.compile("[\ud800-\udfff]")


def _encodable(text: str) -> str:
    """The text with lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no white space and characters as they are; lone surrogates stay escaped."""
    return _encodable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _loaded(text: str):
    """The JSON value; ValueError if the text is none, holds NaN or Infinity, or nests too deeply to be read."""

    def refuse(name):
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=refuse)
        canonical(value)  # numbers like 1e999 are read as infinite
        return value
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer())
        return whole and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What the value breaks of the schema, as `path: reason`, in the schema's order."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {'|'.join(kinds)}"]
    out = [f"{at}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def items(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, kind, idx, body): a row for each message, call and result, in text order."""
    text = F.coalesce("text", F.lit(""))
    one = lambda kind, tag: F.transform(
        F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("idx"), x.alias("body")))
    plain = F.trim(F.regexp_replace(text, r"(?s)<tool_(call|result)>.*?</tool_\1>", ""))
    whole = F.array(F.struct(F.lit("message").alias("kind"), F.lit(0).alias("idx"), plain.alias("body")))
    return messages.select("conv_id", "turn", "role", F.explode_outer(F.concat(whole, one("call", "tool_call"), one("result", "tool_result"))).alias("i")).select("conv_id", "turn", "role", "i.*")


def ordered_calls(calls: list[dict]) -> list[tuple[str, int, int | None]]:
    """(id, level, after) of one conversation's calls (id, turn, on); calls on cycles or with a missing dependency, and what depends on them, are left out."""
    after, level, users = {c["id"]: c["turn"] for c in calls}, {}, {}
    open_ = {c["id"]: len(c["on"]) for c in calls}
    for c in calls:
        for x in c["on"]:
            users.setdefault(x, []).append(c["id"])
    ready = [x for x, n in open_.items() if n == 0]
    for x in ready:  # grows while it is read
        level.setdefault(x, 0)
        for y in users.get(x, ()):
            level[y] = max(level.get(y, 0), level[x] + 1)
            after[y] = max((t for t in (after[x], after[y]) if t is not None), default=None)
            open_[y] -= 1
            if open_[y] == 0:
                ready.append(y)
    return [(x, level[x], after[x]) for x in ready]


def _ordered_batches(batches):
    for b in batches:
        got = [(i, *x) for i, calls in enumerate(b.column("calls").to_pylist()) for x in ordered_calls(calls)]
        row, ids, level, after = zip(*got, strict=True) if got else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id").take(pa.array(row, pa.int64())), pa.array(ids, pa.string()), pa.array(level, pa.int32()), pa.array(after, pa.int64())],
            names=["conv_id", "id", "level", "after"])


def call_levels(calls: DataFrame, deps: DataFrame, whole_calls: int) -> DataFrame:
    """(conv_id, id, level, after), written: level as in _levels(); after, the greatest turn of a call and all it depends on.

    calls: conv_id, id, call_turn; deps: conv_id, id, on, a written table without repeated rows.
    """
    calls = calls.select("conv_id", "id", F.col("call_turn").cast("long").alias("call_turn"))
    wants = deps.groupBy("conv_id", "id").agg(F.collect_list(F.struct("on")).alias("on"))  # a list leaves no struct out, but nulls
    nodes = materialize(calls.join(wants, ["conv_id", "id"], "left").select("conv_id", "id", "call_turn", F.coalesce(F.col("on.on"), F.array().cast("array<string>")).alias("on")), "calls")
    large = materialize(nodes.groupBy("conv_id").agg(F.sum(F.size("on") + 1).alias("n")).filter(F.col("n") > whole_calls).select("conv_id"), "large")
    whole = nodes.join(large, "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("id", F.col("call_turn").alias("turn"), "on")).alias("calls"))
    out = materialize(whole.mapInArrow(_ordered_batches, "conv_id long, id string, level int, after long"), "turns")
    if not large.isEmpty():
        out = materialize(out.union(_by_rounds(nodes.join(large, "conv_id", "left_semi").drop("on"), deps.join(large, "conv_id", "left_semi"))), "turns")
    discard(nodes, large)
    return out


def _by_rounds(calls: DataFrame, deps: DataFrame) -> DataFrame:
    """call_levels() of conversations of any size."""
    deps = materialize(deps, "deps")
    levels = materialize(_levels(calls, deps), "levels")
    turns = materialize(levels.join(calls, ["conv_id", "id"]).select("conv_id", "id", "level", F.col("call_turn").alias("after")), "turns")
    while True:  # a call stands no earlier than what it depends on
        late = deps.join(turns.select("conv_id", F.col("id").alias("on"), F.col("after").alias("dep")), ["conv_id", "on"]).groupBy("conv_id", "id").agg(F.max("dep").alias("dep"))
        later = F.col("dep").isNotNull() & (F.col("after").isNull() | (F.col("dep") > F.col("after")))
        moved = materialize(turns.join(late, ["conv_id", "id"], "left").select("conv_id", "id", "level", F.greatest("after", "dep").alias("after"), later.alias("m")), "turns")
        done = moved.filter("m").isEmpty()
        discard(turns)
        if done:
            return moved.drop("m")
        turns = moved


def _levels(calls: DataFrame, deps: DataFrame) -> DataFrame:
    """(conv_id, id, level): 0 without dependencies, else one more than the deepest; none on cycles.

    A round for each level; calls on cycles never become ready, so the rounds end.
    """
    level = calls.join(deps.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("level"))
    level = materialize(level, "levels")
    parts = [level]
    while True:
        ready = (
            deps.join(level.withColumnRenamed("id", "on"), ["conv_id", "on"], "left").groupBy("conv_id", "id")
            .agg(F.max("level").alias("deep"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0")
            .join(level.select("conv_id", "id"), ["conv_id", "id"], "left_anti").select("conv_id", "id", (F.col("deep") + 1).alias("level"))
        )
        ready = materialize(ready, "levels")
        if ready.isEmpty():
            return level
        level, parts = level.union(ready), [*parts, ready]
        if len(parts) > 8:  # keeps the plan short
            level = materialize(level, "levels")
            discard(*parts)
            parts = [level]


def _finish(p: ChatParams):
    """Validate calls and write each row as canonical JSON."""

    def one(r: dict) -> tuple[list[str], str]:
        errors, out = [], {"kind": r["kind"], "turn": r["turn"]}
        if r["kind"] == "message":
            return errors, canonical(out | {"role": r["role"], "content": r["body"]})
        try:
            body = _loaded(r["body"])
        except ValueError:
            body = None
        if not isinstance(body, dict):
            return ["$: not a JSON object"], canonical(out | {"raw": r["body"], "status": r["status"]})
        out |= {"id": r["id"], "status": r["status"]}
        if r["kind"] == "result":
            return errors, canonical(out | {"content": body.get("content")})
        args = body.get("arguments", {})
        if isinstance(args, str):
            try:
                args = _loaded(args)
            except ValueError:
                errors.append("$: arguments are no JSON")
        schema = p.schemas.get(body.get("name")) if isinstance(body.get("name"), str) else None
        errors += ["$: unknown tool"] if schema is None else [] if errors else violations(args, schema)
        return [_encodable(e) for e in errors], canonical(out | {"name": body.get("name"), "arguments": args})

    def run(batches):
        for b in batches:
            got = [one(r) for r in b.to_pylist()]
            keep = [n for n in b.schema.names if n != "body"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in keep), pa.array([e for e, _ in got], pa.list_(pa.string())), pa.array([j for _, j in got], pa.string())],
                names=[*keep, "errors", "json"],
            )

    return run


def format_chats(messages: DataFrame, p: ChatParams = ChatParams()) -> DataFrame:
    """One row for each message, call and result: conv_id, turn, role, kind, idx, id, status, order_turn,
    level, errors, json.

    Sorted by (conv_id, order_turn, level, turn, idx), calls come after what they depend on and
    results after their call. status is ok for messages; linked or unanswered for calls; linked for
    results; orphan for results without a call, duplicate for the later calls or results of one id,
    cyclic for calls whose dependencies form a circle or are missing, bad for bodies that are no
    JSON object or have no id. NaN, Infinity and nesting beyond Python's recursion limit are no JSON here.
    Messages without conv_id are given, but link nothing. A null text is an empty message; a repeated message is given again,
    its calls as duplicates; an empty table gives an empty result; other columns are ignored.
    """
    parts = items(messages.select("conv_id", "turn", "role", "text"))
    get = lambda f: F.get_json_object("body", f"$.{f}")
    ids = F.when(F.col("kind") != "message", get("id"))
    parts = materialize(parts.withColumn("id", ids).withColumn("uid", F.expr("uuid()")), "items")
    tagged = parts.filter("kind <> 'message' and id is not null and conv_id is not null")
    first = tagged.groupBy("conv_id", "kind", "id").agg(F.min(F.struct("turn", "idx", "uid")).alias("f"))
    calls = first.filter("kind = 'call'").select("conv_id", "id", F.col("f.turn").alias("call_turn"), F.col("f.uid").alias("call_uid"))
    results = first.filter("kind = 'result'").select("conv_id", "id", F.col("f.uid").alias("result_uid"))
    links = calls.join(results, ["conv_id", "id"], "full")
    owner = tagged.filter("kind = 'call'").join(calls.select(F.col("call_uid").alias("uid")), "uid", "left_semi")
    wants = owner.select("conv_id", "id", F.explode(F.array_distinct(F.from_json(get("depends_on"), "array<string>"))).alias("on"))
    deps = materialize(wants, "deps")
    if deps.isEmpty():
        levels = calls.select("conv_id", "id", F.lit(0).alias("level"), F.col("call_turn").alias("after"))
    else:
        levels = call_levels(calls, deps, p.whole_calls)
    info = links.join(levels, ["conv_id", "id"], "left")
    full = parts.join(info, ["conv_id", "id"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(F.col("kind") == "message", "ok").when(F.col("id").isNull(), "bad")
        .when(call & (F.col("uid") != F.col("call_uid")) | result & (F.col("uid") != F.col("result_uid")), "duplicate")
        .when(result & F.col("call_uid").isNull(), "orphan").when(call & F.col("level").isNull(), "cyclic")
        .when(call & F.col("result_uid").isNull(), "unanswered").otherwise("linked")
    )
    order = F.when(call | result, F.greatest("turn", "after")).otherwise(F.col("turn"))
    level = F.when(call, F.col("level") * 2 + 1).when(result, F.coalesce(F.col("level") * 2 + 2, F.lit(2))).otherwise(F.lit(0))
    out = full.select("conv_id", "turn", "role", "kind", "idx", "id", status.alias("status"), F.coalesce(order, F.col("turn")).alias("order_turn"), level.alias("level"), "body")
    fields = "conv_id long, turn long, role string, kind string, idx int, id string, status string, order_turn long, level int, errors array<string>, json string"
    return out.mapInArrow(_finish(p), fields)


#: The tool of with_calls().
LOOKUP = {"lookup": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False}}
_WORD = "[A-Za-z]+"


def with_calls(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with tagged calls and results appended, by fixed rules.

    An assistant's turn t calls lookup as c<t> with its first word and t as arguments, and depends on
    c<t-2> if t > 1. A user's turn t > 1 brings the result of c<t-1>. By conv_id modulo 11, so that
    every status occurs: 1 wrong type, 2 every result twice, 3 an orphan result besides, 4 calls 1, 5,
    9 ... depend on c<t+2> instead (cycles), 5 unknown tool, 6 broken JSON, 7 results come before their
    calls (as c<t+1> in turn t), 8 missing and unknown arguments; 0, 9 and 10 are sound.
    """
    text, kind, t = F.coalesce("text", F.lit("")), F.pmod("conv_id", F.lit(11)), F.col("turn")
    word = F.regexp_extract(text, _WORD, 0)
    limit = F.when(kind == 1, F.lit('"three"')).otherwise(t.cast("string"))
    arguments = F.when(kind == 8, F.concat(F.lit('{"q": "'), word, F.lit('"}'))).otherwise(F.concat(F.lit('{"query": "'), word, F.lit('", "limit": '), limit, F.lit("}")))
    on = F.when((kind == 4) & (t % 4 == 1), t + 2).when(t > 1, t - 2)
    depends = F.coalesce(F.concat(F.lit(', "depends_on": ["c'), on, F.lit('"]')), F.lit(""))
    name = F.when(kind == 5, "nope").otherwise("lookup")
    sound = F.concat(F.lit('{"name": "'), name, F.lit('", "id": "c'), t, F.lit('", "arguments": '), arguments, depends, F.lit("}"))
    call = F.concat(F.lit(" <tool_call>"), F.when(kind == 6, "{oops").otherwise(sound), F.lit("</tool_call>"))
    of = F.when(kind == 7, t + 1).when(t > 1, t - 1)
    one = F.concat(F.lit('<tool_result>{"id": "c'), of, F.lit('", "content": "'), word, F.lit('"}</tool_result>'))
    orphan = F.when(kind == 3, F.concat(F.lit('<tool_result>{"id": "x'), t, F.lit('", "content": null}</tool_result>')))
    results = F.concat(F.lit(" "), F.coalesce(one, F.lit("")), F.when(kind == 2, F.coalesce(one, F.lit(""))).otherwise(""), F.coalesce(orphan, F.lit("")))
    tail = F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", results)
    return turns.withColumn("text", F.concat(text, F.coalesce(tail, F.lit(""))))


def chat_digest(turns: DataFrame) -> DataFrame:
    """format_chats() of with_calls(), with the errors of a call as one text."""
    out = format_chats(with_calls(turns.select("conv_id", "turn", "role", "text")), ChatParams(LOOKUP))
    return out.withColumn("errors", F.array_join("errors", "; "))


ORACLE_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, ((conv_id % 11) + 11) % 11 AS k, regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0) AS word FROM conversations),
c AS (SELECT conv_id, turn, role, k, word, CASE WHEN k <> 6 THEN concat('c', turn) END AS id,
    CASE WHEN k = 6 THEN NULL WHEN k = 4 AND turn % 4 = 1 THEN concat('c', turn + 2) WHEN turn > 1 THEN concat('c', turn - 2) END AS dep FROM m WHERE role = 'assistant'),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) AS rn FROM c WHERE id IS NOT NULL) WHERE rn = 1),
lv AS (SELECT conv_id, id, 0 AS level FROM first WHERE dep IS NULL UNION ALL SELECT f.conv_id, f.id, level + 1 FROM lv JOIN first f ON f.conv_id = lv.conv_id AND f.dep = lv.id),
r AS (
  SELECT conv_id, turn, role, k, 1 AS idx, concat('c', CASE WHEN k = 7 THEN turn + 1 ELSE turn - 1 END) AS id, to_json(word) AS content FROM m WHERE role = 'user' AND (k = 7 OR turn > 1)
  UNION ALL SELECT conv_id, turn, role, k, 2, concat('c', turn - 1), to_json(word) FROM m WHERE role = 'user' AND k = 2 AND turn > 1
  UNION ALL SELECT conv_id, turn, role, k, CASE WHEN turn > 1 THEN 2 ELSE 1 END, concat('x', turn), 'null' FROM m WHERE role = 'user' AND k = 3),
rn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, idx) AS rn FROM r),
calls AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.conv_id, c.id ORDER BY c.turn) AS n, l.level, a.id IS NOT NULL AS answered
  FROM c LEFT JOIN lv l ON l.conv_id = c.conv_id AND l.id = c.id LEFT JOIN rn a ON a.conv_id = c.conv_id AND a.id = c.id AND a.rn = 1),
named AS (SELECT *, CASE WHEN id IS NULL THEN 'bad' WHEN n > 1 THEN 'duplicate' WHEN level IS NULL THEN 'cyclic' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status FROM calls),
results AS (
  SELECT rn.*, CASE WHEN rn.rn > 1 THEN 'duplicate' WHEN f.id IS NULL THEN 'orphan' ELSE 'linked' END AS status, CASE WHEN l.id IS NULL THEN NULL ELSE f.turn END AS after, l.level
  FROM rn LEFT JOIN first f ON f.conv_id = rn.conv_id AND f.id = rn.id LEFT JOIN lv l ON l.conv_id = rn.conv_id AND l.id = rn.id)
SELECT conv_id, turn, role, 'message' AS kind, 0 AS idx, NULL AS id, 'ok' AS status, turn AS order_turn, 0 AS level, '' AS errors,
  concat('{"content":', to_json(trim(text, ' ')), ',"kind":"message","role":', coalesce(to_json(role), 'null'), ',"turn":', turn, '}') AS json FROM m
UNION ALL SELECT conv_id, turn, role, 'call', 1, id, status, turn, level * 2 + 1,
  CASE k WHEN 1 THEN '$.limit: not integer' WHEN 5 THEN '$: unknown tool' WHEN 6 THEN '$: not a JSON object' WHEN 8 THEN '$.query: missing; $.q: unknown' ELSE '' END,
  CASE WHEN k = 6 THEN concat('{"kind":"call","raw":"{oops","status":"bad","turn":', turn, '}') ELSE
    concat('{"arguments":', CASE WHEN k = 8 THEN concat('{"q":', to_json(word), '}') ELSE concat('{"limit":', CASE WHEN k = 1 THEN '"three"' ELSE CAST(turn AS VARCHAR) END, ',"query":', to_json(word), '}') END,
      ',"id":"', id, '","kind":"call","name":"', CASE WHEN k = 5 THEN 'nope' ELSE 'lookup' END, '","status":"', status, '","turn":', turn, '}') END FROM named
UNION ALL SELECT conv_id, turn, role, 'result', idx, id, status, greatest(turn, coalesce(after, turn)), coalesce(level * 2 + 2, 2), '',
  concat('{"content":', content, ',"id":"', id, '","kind":"result","status":"', status, '","turn":', turn, '}') FROM results"""
