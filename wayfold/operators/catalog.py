"""Catalog queries: filter, count, order and page over one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.keys import clamp_limit, under

TRUE_WORDS = ("1", "true", "yes")


@dataclass(frozen=True)
class CatalogSpec:
    """text: columns that q is searched in; equal: parameter to column, compared without case;
    below: parameter to key column, matched hierarchically; member: parameter to array column;
    flag: (parameter, column) that is excluded unless the parameter is set; order: the row order.
    """

    text: Sequence[str] = ()
    equal: Mapping[str, str] = field(default_factory=dict)
    below: Mapping[str, str] = field(default_factory=dict)
    member: Mapping[str, str] = field(default_factory=dict)
    flag: tuple[str, str] | None = None
    order: Sequence[str] = ()


def contains_text(columns: Sequence[str], q: str) -> Column:
    """q occurs in the columns joined by ` / `, without case; nulls count as empty."""
    return F.contains(F.lower(F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), F.lit(q.lower()))


def contains_json(column: str, q: str) -> Column:
    """q occurs in the column's JSON text, without case."""
    return F.contains(F.lower(F.to_json(column)), F.lit(q.lower()))


def matching(df: DataFrame, spec: CatalogSpec, params: Mapping[str, str | None]) -> DataFrame:
    """All rows that the parameters let through; an absent or empty parameter lets all through."""
    get = lambda k: (params.get(k) or "").strip() if isinstance(params.get(k), str) or params.get(k) is None else params[k]
    if get("q") and spec.text:
        df = df.filter(contains_text(spec.text, get("q")))
    for k, c in spec.equal.items():
        if get(k):
            df = df.filter(F.lower(c) == get(k).lower())
    for k, c in spec.below.items():
        if get(k):
            df = df.filter(under(F.col(c), get(k)))
    for k, c in spec.member.items():
        if get(k):
            df = df.filter(F.array_contains(c, get(k)))
    if spec.flag and (get(spec.flag[0]) or "").lower() not in TRUE_WORDS:
        df = df.filter(~F.coalesce(spec.flag[1], F.lit(False)))
    return df


def catalog_query(df: DataFrame, spec: CatalogSpec, params: Mapping[str, str | None], missing: int = 100, wrong: int = 100) -> tuple[DataFrame, DataFrame]:
    """(page, totals): the first rows by spec.order up to the clamped limit; record_count and total_matches.

    Paging sorts with a limit, so a task keeps no more than a page; the total is one count.
    """
    found = matching(df, spec, params)
    page = found.orderBy(*spec.order).limit(clamp_limit(params.get("limit"), missing, wrong))
    total = found.agg(F.count("*").alias("total_matches"))
    n = clamp_limit(params.get("limit"), missing, wrong)
    return page, total.select(F.least(F.col("total_matches"), F.lit(n)).cast("long").alias("record_count"), "total_matches")


def either_side(df: DataFrame, left: str, right: str, prefix: str, names: tuple[str, str] = ("source", "destination")) -> DataFrame:
    """Rows one of whose keys is below prefix, with match_side; the first side is preferred."""
    a, b = under(F.col(left), prefix), under(F.col(right), prefix)
    return df.filter(a | b).withColumn("match_side", F.when(a, names[0]).otherwise(names[1]))


def bind_identity(df: DataFrame, bindings: DataFrame, key: str, candidates: str = "formal_candidates") -> DataFrame:
    """df with formal_binding (formal_id, binding_basis, identity_only true, routeable false) from bindings (key, formal_id, binding_basis, seq).

    The last binding of a key counts, and its id is appended to the row's candidates if it is not
    among them. Rows without a binding stay as they are, with a null formal_binding.
    """
    made = F.struct("formal_id", "binding_basis", F.lit(True).alias("identity_only"), F.lit(False).alias("routeable"))
    last = bindings.groupBy(key).agg(F.max_by(made, "seq").alias("formal_binding"))
    out = df.join(last, key, "left")
    have, new = F.coalesce(candidates, F.array().cast("array<string>")), F.col("formal_binding.formal_id")
    return out.withColumn(candidates, F.when(F.col("formal_binding").isNull(), F.col(candidates)).when(F.array_contains(have, new), have).otherwise(F.array_append(have, new)))


def kind_first(df: DataFrame, kinds: Sequence[str], label: str = "label", tie: str = "id") -> DataFrame:
    """Ordered by the kinds as listed, others last, then by label."""
    at = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return df.orderBy(F.when(F.coalesce(at, F.lit(0)) == 0, len(kinds)).otherwise(at - 1), in_chinese_order(label), tie)


def in_chinese_order(label: str) -> Column:
    """A sort key: the label under Chinese collation, nulls as empty."""
    return F.collate(F.coalesce(F.col(label), F.lit("")), "zh")


def exact_key(tables: Mapping[str, DataFrame], key: str, value) -> dict[str, DataFrame]:
    """The rows of one key in each of several tables."""
    return {name: t.filter(F.col(key) == value) for name, t in tables.items()}


def either_endpoint(df: DataFrame, field: str, value, ends: Sequence[str] = ("from", "to")) -> DataFrame:
    """Rows one of whose endpoint structs has the value in the field."""
    hit = F.lit(False)
    for e in ends:
        hit = hit | F.coalesce(F.col(e)[field] == value, F.lit(False))
    return df.filter(hit)


def with_role(df: DataFrame, column: str, roles: Mapping[str, str], out: str = "role") -> DataFrame:
    """Rows whose type is listed, with its role."""
    known = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return df.filter(F.col(column).isin(*roles)).withColumn(out, F.element_at(known, F.col(column)))


def with_default(df: DataFrame, table: DataFrame, key: str, out: str, default: Mapping[str, object]) -> DataFrame:
    """df with a struct of table's one row of the key, or of the defaults where it has none."""
    fields = [x for x in table.columns if x != key]
    kinds = dict(table.dtypes)
    side = table.groupBy(key).agg(F.min(F.struct(*fields)).alias(out))
    none = F.struct(*[F.lit(default.get(f)).cast(kinds[f]).alias(f) for f in fields])
    return df.join(side, key, "left").withColumn(out, F.coalesce(out, none))


def add_if_absent(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df and those rows whose key it does not hold."""
    return df.unionByName(rows.join(df.select(key), key, "left_anti"), allowMissingColumns=True)
