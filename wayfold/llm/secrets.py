"""Operator 5: secret scans through a trigram inverted index, in built-in functions only.

Each rule's regex yields a Boolean query over trigrams that every match must contain. The index
holds, for the trigrams of all queries, the postings (trigram, document); a document is a candidate
of a rule if its postings satisfy the rule's query, and only candidates are verified by the regex.
A rule without mandatory trigrams is verified on every document.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.spans import Kind, count_kind, spans_sql, with_spans, written
from wayfold.storage import materialize

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_FOLD = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
_ASSIGN_SQL = "".join([*(_FOLD.get(c, c) for c in "(password|passwd|secret|token|api_?key)"), _ASSIGN.split(")", 1)[1]])
_TAIL = r"^(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
_always = lambda m: F.lit(True)


def _long_enough(m: Column) -> Column:
    """Group 2 has 6 characters or more."""
    return F.length(F.regexp_replace(m, F.lit("(?i)" + _TAIL), F.lit(""))) >= 6


#: The contract's kinds, in its order.
BASE = [
    Kind("assign", "(?i)" + _ASSIGN, _long_enough, _ASSIGN_SQL, "length(regexp_replace(m, '" + ("".join(_FOLD.get(c, c) for c in "^(password|passwd|secret|token|api_?key)") + _TAIL.split(")", 1)[1]).replace("'", "''") + "', '')) >= 6"),
    Kind("access", r"AKIA[A-Z0-9]{16,}+", _always, r"AKIA[A-Z0-9]{16,}", "true"),
    Kind("hex", r"[0-9a-f]{24,}+", _always, r"[0-9a-f]{24,}", "true"),
]
#: Public token formats that the method adds.
ADDED = [
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36}", _always, r"gh[pousr]_[A-Za-z0-9]{36}", "true"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", _always, r"xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    Kind("google", r"AIza[A-Za-z0-9_-]{35}", _always, r"AIza[A-Za-z0-9_-]{35}", "true"),
    Kind("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", _always, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", _always, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
]


@dataclass(frozen=True)
class SecretParams:
    """broadcast_rows is the most candidates that are broadcast to their texts; more are joined by a shuffle."""

    kinds: tuple[Kind, ...] = (*BASE, *ADDED)
    n_base: int = len(BASE)
    broadcast_rows: int = 200_000


def _sequence(nodes, most: int = 64) -> tuple[list[frozenset], set[str] | None]:
    """Clauses (each an OR of trigram sets) of a regex sequence, and its exact strings if they are few."""
    clauses, exact, whole = [], {""}, True

    def flush():
        nonlocal exact
        clauses.extend(_clause(exact))
        exact = {""}

    for op, arg in nodes:
        strings = None
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            strings = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            inner, strings = _sequence(arg[3], most)
            if strings is None:
                clauses.extend(inner)
        elif op is C.BRANCH:
            branches = [_sequence(b, most) for b in arg[1]]
            if all(s is not None for _, s in branches):
                strings = set().union(*(s for _, s in branches))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, some = _sequence(body, most)
            if some is not None and (low, high) == (0, 1):
                strings = some | {""}
            elif some is not None and low == high == 1:
                strings = some
            elif low > 0:
                clauses.extend(inner if some is None else _clause(some))
        if strings is None or len(exact) * len(strings) > most:
            flush()
            whole = whole and strings is not None
            exact = strings or {""}
            if strings is None:
                whole = False
        else:
            exact = {a + b for a in exact for b in strings}
        whole = whole and strings is not None
    if whole and not clauses:
        return [], exact
    flush()
    return clauses, None


def _clause(strings: set[str]) -> list[frozenset]:
    if any(len(s) < 3 for s in strings):
        return []
    return [frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)]


def trigram_query(regex: str) -> list[list[list[str]]]:
    """AND over clauses, OR over alternatives, AND over trigrams (lower case); empty: no mandatory trigram."""
    clauses, exact = _sequence(parser.parse(regex))
    if exact is not None:
        clauses = _clause(exact)
    return sorted({tuple(sorted(tuple(sorted(a)) for a in c)) for c in clauses})


def _escape(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def _trie(trigrams: list[str]) -> str:
    """A regex for the trigrams that tests each character once."""
    heads: dict[str, dict[str, str]] = {}
    for t in sorted(trigrams):
        heads.setdefault(t[0], {}).setdefault(t[1], "")
        heads[t[0]][t[1]] += _escape(t[2])
    return "|".join(f"{_escape(a)}(?:" + "|".join(f"{_escape(b)}[{last}]" for b, last in rest.items()) + ")" for a, rest in heads.items())


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, doc_id, text_hash) for the given trigrams, lower-cased."""
    found = F.regexp_extract_all("text", F.lit(f"(?=((?i:{_trie(trigrams)})))"), F.lit(1))
    # explode() would have its input computed twice, for a filter on its size
    every = F.explode_outer(F.array_distinct(F.transform(found, F.lower)))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), every.alias("trigram")).filter("trigram is not null")


def _holds(query, has: Column) -> Column:
    out = F.lit(True)
    for clause in query:
        some = F.lit(False)
        for alternative in clause:
            some = some | F.forall(F.array(*[F.lit(t) for t in alternative]), lambda t: F.array_contains(has, t))
        out = out & some
    return out


def candidates(docs: DataFrame, queries: list) -> DataFrame:
    """(doc_id, text_hash, rules): which queries a document's intersected postings satisfy, if any."""
    needed = sorted({t for q in queries for c in q for a in c for t in a})
    merged = postings(docs, needed).groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("has"))
    rules = F.array(*[_holds(q, F.col("has")) if q else F.lit(True) for q in queries])
    indexed = [i for i, q in enumerate(queries) if q]
    return merged.select("doc_id", "text_hash", rules.alias("rules")).filter(F.exists(F.array(*[F.col("rules")[i] for i in indexed]), lambda x: x))


def secret_spans(docs: DataFrame, p: SecretParams = SecretParams(), keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text and any others) with spans added: structs (start, end, kind) in code points.

    A null text counts as empty. Repeated rows are scanned one by one; null doc_ids are joined like
    equal ids; a column spans of docs is replaced. keep_text says whether text is returned.
    """
    kinds = list(p.kinds)
    docs = docs.drop("spans").withColumn("text", F.coalesce("text", F.lit("")))
    others = F.struct(*[c for c in docs.columns if keep_text or c != "text"])
    docs = docs.select(others.alias("_row"), "doc_id", "text")
    queries = [trigram_query(k.regex) for k in kinds]
    if any(queries):
        found = materialize(candidates(docs, queries).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("rules").alias("_rules")), "candidates")
        if found.count() <= p.broadcast_rows:  # texts then stay where they are
            found = F.broadcast(found)
        docs = docs.withColumn("_h", F.xxhash64("text"))
        docs = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.col("_h") == F.col("_hash")), "left")
        given = F.array(*[F.coalesce(F.get("_rules", F.lit(i)), F.lit(False)) if q else F.lit(True) for i, q in enumerate(queries)])
        docs = docs.withColumn("_given", given)
        return with_spans(docs, "text", kinds, "spans", F.col("_given")).select("_row.*", "spans")
    return with_spans(docs, "text", kinds, "spans").select("_row.*", "spans")


def secret_digest(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """The contract's columns."""
    found = secret_spans(docs.select("doc_id", "text"), p)
    names, base = [k.name for k in p.kinds], F.filter("spans", lambda x: x["kind"] < p.n_base)
    counts = [count_kind(F.col("spans"), i).alias(f"n_{names[i]}") for i in range(p.n_base)]
    return found.select("doc_id", *counts, F.sha2(written(base, names), 256).alias("base_sha256"), written(F.col("spans"), names).alias("spans"))


def redact(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """docs with each secret of the text replaced by <kind>; overlapping spans become one, named by the first."""
    row = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")
    found, names = secret_spans(docs.select(row, "doc_id", "text"), p, keep_text=True), F.array(*[F.lit(f"<{k.name}>") for k in p.kinds])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a, x):
        gap = F.substring(F.col("text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        new = F.when(x["start"] >= a["at"], F.concat(a["out"], gap, F.get(names, x["kind"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), new.alias("out"))

    done = F.aggregate("spans", start, step)
    found = found.withColumn("_r", F.when(F.size("spans") > 0, done))
    rest = F.expr("substring(text, cast(_r.at + 1 as int))")
    text = F.when(F.col("_r").isNotNull(), F.concat(F.col("_r.out"), rest)).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def _digest_sql(kinds: list[Kind], n_base: int) -> str:
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = {i}) AS BIGINT) AS n_{k.name}" for i, k in enumerate(kinds[:n_base]))
    named = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in kinds[:n_base])
    return f"""
WITH found AS ({spans_sql(kinds)}),
digest AS (SELECT doc_id, {counts},
  coalesce(string_agg(concat(name, ':', s, ':', e), ',' ORDER BY s, kind) FILTER (WHERE kind < {n_base}), '') AS base,
  string_agg(concat(name, ':', s, ':', e), ',' ORDER BY s, kind) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN digest USING (doc_id)"""


ORACLE_SQL = _digest_sql([*BASE, *ADDED], len(BASE))
