"""Leftmost non-overlapping regex matches with code-point offsets, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element type of a list of spans.
SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: a Java regex that never backtracks over a long text, and a condition on a match.

    sql_regex and sql_passes say the same for DuckDB (passes over the match m).
    """

    name: str
    regex: str
    passes: Callable[[Column], Column]
    sql_regex: str
    sql_passes: str


def with_spans(df: DataFrame, text: str, kinds: list[Kind], out: str, given: Column | None = None) -> DataFrame:
    """df with `out`, the passing matches of all kinds by start, then kind as listed.

    A match's place follows from the text between the matches: split() gives the pieces around
    exactly those matches that regexp_extract_all() returns. given: a boolean array column that says
    for each kind whether the text can hold a match at all.
    """
    m, s = [f"_m{i}" for i in range(len(kinds))], [f"_s{i}" for i in range(len(kinds))]
    none = F.array().cast("array<string>")
    found = {}
    for i, k in enumerate(kinds):
        all_ = F.regexp_extract_all(text, F.lit(k.regex), F.lit(0))
        found[m[i]] = all_ if given is None else F.when(given[i], all_).otherwise(none)
    df = df.withColumns(found)
    df = df.withColumns({s[i]: F.when(F.size(m[i]) > 0, F.split(text, k.regex, -1)) for i, k in enumerate(kinds)})
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))
    lists = []
    for i, k in enumerate(kinds):
        step, got = _step(i, k, s[i]), F.array().cast(SPANS)
        lists.append(F.when(F.size(m[i]) > 0, F.aggregate(m[i], start, step, lambda a: a["out"])).otherwise(got))
    df = df.withColumn(out, _sorted(F.concat(*lists)))
    return df.drop(*m, *s)


def _step(i: int, k: Kind, pieces: str) -> Callable[[Column, Column], Column]:
    """Moves the place past the next piece and match, and keeps the match if it passes."""

    def step(a, x):
        here = a["at"] + F.length(F.get(F.col(pieces), a["i"]))
        end = here + F.length(x)
        span = F.array(F.struct(here.alias("start"), end.alias("end"), F.lit(i).alias("kind")))
        return F.struct((a["i"] + 1).alias("i"), end.alias("at"), F.when(k.passes(x), F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return step


def _sorted(spans: Column) -> Column:
    """By start, then kind."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def count_kind(spans: Column, i: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == i)).cast("long")


def written(spans: Column, names: list[str]) -> Column:
    """kind:start:end of all spans, comma-joined."""
    known = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(known, x["kind"]), x["start"], x["end"])), ",")


def spans_sql(kinds: list[Kind], table: str = "documents", text: str = "text") -> str:
    """DuckDB SQL for rows (doc_id, kind, name, s, e) of table's passing matches."""
    parts = []
    for i, k in enumerate(kinds):
        rx = k.sql_regex.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {i} AS kind, '{k.name}' AS name, s, s + length(m) AS e FROM (
    SELECT doc_id, m, (SELECT coalesce(sum(length(x)), 0) FROM unnest(p[:i]) z(x)) + (SELECT coalesce(sum(length(x)), 0) FROM unnest(a[:i - 1]) z(x)) AS s FROM (
      SELECT doc_id, a, p, unnest(a) AS m, unnest(range(1, len(a) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all({text}, '{rx}') AS a, string_split_regex({text}, '{rx}') AS p FROM {table} WHERE {text} IS NOT NULL))
  ) WHERE {k.sql_passes}""")
    return " UNION ALL ".join(parts)
