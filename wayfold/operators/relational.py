"""Joins with checked uniqueness, ordered fallbacks, narrowing, and the aggregates and windows beside them.

All are plain equi-joins and group-bys, so Spark partitions and spills them and adaptive execution
splits hot keys; the counted side is pre-aggregated before it meets the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.storage import materialize


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def resolve_unique(left: DataFrame, right: DataFrame, keys, payload: str, out: str = "match") -> DataFrame:
    """left with <out> (the one payload of its key, else null), <out>_count and <out>_status: exact, ambiguous, not_found."""
    keys = _keys(keys)
    one = right.groupBy(*keys).agg(F.count("*").alias(f"{out}_count"), F.min(payload).alias("_p"))
    got = left.join(one, keys, "left").withColumn(f"{out}_count", F.coalesce(f"{out}_count", F.lit(0)).cast("long"))
    n = F.col(f"{out}_count")
    return got.withColumn(f"{out}_status", F.when(n == 1, "exact").when(n > 1, "ambiguous").otherwise("not_found")).withColumn(out, F.when(n == 1, F.col("_p"))).drop("_p")


def resolve_chain(left: DataFrame, steps: Sequence[tuple[DataFrame, Sequence[str], str, str]], stop_on_ambiguous: bool = True) -> DataFrame:
    """left with match and basis from the first resolver (table, keys, payload, name) that decides.

    A resolver with one row for the key decides; with several it decides for null (ambiguous) if
    stop_on_ambiguous, else the next is asked. basis names the resolver, ambiguous or not_found.
    """
    out = left.withColumns({"match": F.lit(None).cast("string"), "basis": F.lit(None).cast("string")})
    for i, (table, keys, payload, name) in enumerate(steps):
        got = resolve_unique(out, table, keys, payload, f"_r{i}")
        is_open = F.col("basis").isNull()
        match = F.when(is_open & (F.col(f"_r{i}_status") == "exact"), F.col(f"_r{i}").cast("string")).otherwise(F.col("match"))
        basis = F.when(is_open & (F.col(f"_r{i}_status") == "exact"), name)
        if stop_on_ambiguous:
            basis = basis.when(is_open & (F.col(f"_r{i}_status") == "ambiguous"), "ambiguous")
        out = got.withColumns({"match": match, "basis": basis.otherwise(F.col("basis"))}).drop(f"_r{i}", f"_r{i}_count", f"_r{i}_status")
    return out.withColumn("basis", F.coalesce("basis", F.lit("not_found")))


def longest_prefix(left: DataFrame, text: str, rules: DataFrame, prefix: str, payload: str) -> DataFrame:
    """left with payload of the longest rule prefix that its text begins with, null without one.

    Each row asks for the few prefix lengths that rules have, so this is an equi-join, not a scan of all rules.
    """
    rules = rules.select(F.col(prefix).alias("_x"), F.col(payload).alias("_y"))
    lengths = sorted(r[0] for r in rules.select(F.length("_x").alias("n")).distinct().collect() if r[0] is not None)
    if not lengths:
        return left.withColumn(payload, F.lit(None).cast("string"))
    out = left
    found = []
    for n in lengths[::-1]:
        some = rules.filter(F.length("_x") == n).groupBy(F.col("_x").alias(f"_x{n}")).agg(F.min("_y").alias(f"_y{n}"))
        out = out.join(some, F.when(F.length(text) >= n, F.substring(F.col(text), 1, n)) == F.col(f"_x{n}"), "left")
        found.append(f"_y{n}")
    return out.withColumn(payload, F.coalesce(*found)).drop(*found, *[f"_x{n}" for n in lengths])


def reverse_pairs(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """df with reverse_ids, the keys of rows that run from b to a."""
    back = df.groupBy(F.col(b).alias(a), F.col(a).alias(b)).agg(F.array_sort(F.collect_list(key)).alias("reverse_ids"))
    return df.join(back, [a, b], "left").withColumn("reverse_ids", F.coalesce("reverse_ids", F.array().cast(back.schema["reverse_ids"].dataType)))


def two_sided(df: DataFrame, keys, side: str, value: str, sides: tuple[str, str]) -> DataFrame:
    """(keys, <side 0>, <side 1>): groups of exactly two rows, one of each side."""
    keys = _keys(keys)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(side) == s).alias(f"n_{s}") for s in sides], *[F.max(F.when(F.col(side) == s, F.col(value))).alias(s) for s in sides])
    return g.filter((F.col("n") == 2) & (F.col(f"n_{sides[0]}") == 1) & (F.col(f"n_{sides[1]}") == 1)).select(*keys, *sides)


def contains_unique(left: DataFrame, right: DataFrame, on, needle: str, hay: str, key: str) -> DataFrame:
    """Pairs of rows that agree on `on` and where hay contains needle, if a left key has just one."""
    pairs = left.join(right, _keys(on)).filter(F.contains(hay, needle))
    return pairs.withColumn("_n", F.count("*").over(W.partitionBy(key))).filter("_n = 1").drop("_n")


def offset_join(left: DataFrame, right: DataFrame, a: str, b: str, offset: int) -> DataFrame:
    """Rows with b = a - offset."""
    return left.withColumn(b, F.col(a) - F.lit(offset)).join(right, b)


def range_slice(left: DataFrame, start: str, count: str, items: DataFrame, key, pos: str, width: int = 64) -> DataFrame:
    """left joined with the items of its key at positions start <= pos < start + max(0, count).

    Positions are put into bins of `width`, and a row asks for the bins that its range touches, so the
    join is on (key, bin): a key with many rows and items makes no more pairs than ranges cover.
    """
    last = F.col(start) + F.col(count) - 1
    bins = F.when(F.col(count) > 0, F.sequence(F.floor(F.col(start) / width), F.floor(last / width)))
    asked = left.withColumn("_bin", F.explode(bins))
    joined = asked.join(items.withColumn("_bin", F.floor(F.col(pos) / width)), [*_keys(key), "_bin"])
    return joined.filter((F.col(pos) >= F.col(start)) & (F.col(pos) <= last)).drop("_bin")


def narrow(candidates: DataFrame, query: str, *flags: Column) -> DataFrame:
    """Of a query's candidates, those that fulfil each condition in turn if any does."""
    for f in flags:
        best = F.max(F.coalesce(f, F.lit(False)).cast("int")).over(W.partitionBy(query))
        candidates = candidates.withColumn("_b", best).filter((F.col("_b") == 0) | f).drop("_b")
    return candidates


def narrow_by_key(queries: DataFrame, candidates: DataFrame, on, *flags: Column) -> DataFrame:
    """queries joined with what narrow() leaves of the candidates of their key, where the conditions are on candidates alone.

    All queries of a key have the same candidates, so these are narrowed once a key, before the join:
    what is left of a key has the greatest (flag, flag, ...) in it. The join makes result rows only.
    """
    keys, flag = _keys(on), F.struct(*[F.coalesce(f, F.lit(False)).alias(f"_f{i}") for i, f in enumerate(flags)])
    best = candidates.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(flag).alias("_best"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    left = materialize(candidates.withColumn("_flag", flag).join(best, same & (F.col("_flag") == F.col("_best"))).select(*candidates.columns), "narrowed")
    return queries.join(left, keys)


def first_wins(df: DataFrame, keys, order) -> tuple[DataFrame, DataFrame]:
    """(published, repeated): the first row of each key by order, and the others."""
    r = df.withColumn("_r", F.row_number().over(W.partitionBy(*_keys(keys)).orderBy(*_keys(order))))
    return r.filter("_r = 1").drop("_r"), r.filter("_r > 1").drop("_r")


def last_wins(df: DataFrame, keys, order: str) -> DataFrame:
    """One row a key, the last by order, by a map-side combined aggregate."""
    row = F.struct(*df.columns)
    return df.groupBy(*_keys(keys)).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def carry_forward(df: DataFrame, value: str, part, order) -> DataFrame:
    """df with value replaced by its last non-null value so far within the part."""
    w = W.partitionBy(*_keys(part)).orderBy(*_keys(order)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def valid_ordinal(df: DataFrame, valid: Column, part, order) -> Column:
    """How many valid rows of the part come before this one."""
    return F.coalesce(F.sum(valid.cast("long")).over(W.partitionBy(*_keys(part)).orderBy(*_keys(order)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def first_samples(df: DataFrame, keys, value: str, order, n: int = 8) -> DataFrame:
    """(keys, samples): the first n values of each key; Spark prunes rows past n before the shuffle."""
    keys = _keys(keys)
    top = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*_keys(order)))).filter(F.col("_r") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("samples"))


def counts_with_totals(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, inner, n): counts for each pair and, with outer null, over all; one rollup shuffle of partial counts."""
    pairs = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    total = pairs.groupBy(inner).agg(F.sum("n").alias("n")).select(F.lit(None).cast(dict(df.dtypes)[outer]).alias(outer), inner, "n")
    return pairs.unionByName(total)


def axis_bounds(df: DataFrame, keys, axes: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Per key: count, min and max of each axis over its numeric values, and rows with an axis off zero."""
    off = F.lit(False)
    for a in axes:
        off = off | (F.abs(F.col(a).try_cast("double")) > eps)
    aggs = [F.count("*").alias("n"), F.count_if(off).alias("n_nonzero")]
    for a in axes:
        v = F.col(a).try_cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.min(v).alias(f"min_{a}"), F.max(v).alias(f"max_{a}")]
    return df.groupBy(*_keys(keys)).agg(*aggs)


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (lo, hi) of rows whose ends differ."""
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only left, only right, in both, and the covered fraction of the left keys (0 if it has none)."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    got = a.join(b, key, "full").agg(
        F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))
    return got.withColumn("fraction", F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("both") + F.col("left_only")), F.lit(0.0)))


def content_dedup(df: DataFrame, body: Column) -> DataFrame:
    """(content_id, occurrences, body): equal bodies become one row named by its SHA-256."""
    return df.select(body.alias("body")).groupBy(F.sha2("body", 256).alias("content_id")).agg(F.count("*").alias("occurrences"), F.min("body").alias("body"))


def common_to_all(lists: Column) -> Column:
    """What all arrays of an array have in common."""
    return F.when(F.size(lists) > 0, F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), lists[0], lambda a, x: F.array_intersect(a, x))).otherwise(lists[0])


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def ranked_per_direction(edges: DataFrame, out: int = 4, into: int = 3, order: str = "seq") -> DataFrame:
    """(node, direction, other, rank): each node's first outgoing and incoming edges."""
    a = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other"), order)
    b = edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other"), order)
    ranked = a.union(b).withColumn("rank", F.row_number().over(W.partitionBy("node", "direction").orderBy(order, "other")))
    return ranked.filter((F.col("rank") <= out) & (F.col("direction") == "out") | (F.col("rank") <= into) & (F.col("direction") == "in")).drop(order)


def repeated_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*_keys(keys)).agg(F.count("*").alias("n")).filter("n > 1")


def full_inventory(missing: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The missing rows and the present ones that are not among them, with state."""
    rest = present.join(missing.select(key), key, "left_anti")
    return missing.withColumn("state", F.lit("missing")).unionByName(rest.withColumn("state", F.lit("present")), allowMissingColumns=True)


def alias_matches(needs: DataFrame, aliases: DataFrame, held: DataFrame) -> DataFrame:
    """(holder, requirements): needs (req, name) and aliases (name, alias) met by held (holder, item), without case."""
    names = needs.select("req", F.lower("name").alias("item")).union(needs.join(aliases, "name").select("req", F.lower("alias").alias("item"))).distinct()
    got = held.select("holder", F.lower("item").alias("item")).distinct().join(names, "item")
    return got.groupBy("holder").agg(F.array_sort(F.collect_set("req")).alias("requirements"))


def explode_lookup(df: DataFrame, key: str, ids: str, table: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(key, found): the payloads of an array of foreign keys, in the array's order."""
    rows = df.select(key, F.posexplode(ids).alias("_pos", id_col)).join(table.select(id_col, payload), id_col)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", payload))), lambda x: x[payload]).alias("found"))


def union_tagged(**tables: DataFrame) -> DataFrame:
    """All tables with the name of each as kind; absent columns are null."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("kind", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def not_own_match(left: DataFrame, right: DataFrame, key: str, own: str, value: str) -> DataFrame:
    """left with status and match by key among right rows of another owner: exact, ambiguous, own_only, not_found.

    The right side is pre-aggregated to one row a (key, owner), so a hot key does not multiply.
    """
    per = right.groupBy(key, F.col(own).alias("_o")).agg(F.count("*").alias("n"), F.min(value).alias("v"))
    every = per.groupBy(key).agg(F.sum("n").alias("_all"), F.min(F.struct("v", "_o")).alias("_lo"), F.max(F.struct("v", "_o")).alias("_hi"))
    mine = per.select(key, F.col("_o").alias(own), F.col("n").alias("_mine"), F.col("v").alias("_own_v"))
    got = left.join(every, key, "left").join(mine, [key, own], "left")
    others = F.coalesce("_all", F.lit(0)) - F.coalesce("_mine", F.lit(0))
    pick = F.when(F.col("_lo._o").eqNullSafe(F.col(own)), F.col("_hi.v")).otherwise(F.col("_lo.v"))
    status = F.when(others == 1, "exact").when(others > 1, "ambiguous").when(F.coalesce("_mine", F.lit(0)) > 0, "own_only").otherwise("not_found")
    return got.withColumns({"status": status, "match": F.when(others == 1, pick)}).drop("_all", "_lo", "_hi", "_mine", "_own_v")


def source_counts(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, total, kinds, by_source): rows of each key, its sources in order, and (source, n) of each."""
    per = df.groupBy(key, source).agg(F.count("*").alias("n"))
    got = per.groupBy(key).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(source, "n"))).alias("by_source"))
    return got.select(key, "total", F.transform("by_source", lambda x: x[source]).alias("kinds"), "by_source")


def frequency_dictionary(df: DataFrame, key: str) -> DataFrame:
    """(key, n, rank): values by falling frequency, ties by value; ranked by ranges of the counted values, not in one task."""
    return numbered(df.groupBy(key).agg(F.count("*").alias("n")), [F.desc("n"), F.asc(key)], "rank")


def numbered(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """df with out, its place from 1 on in a total order.

    Rows are dealt into ranges of the order; a row's number is its number in its range and the size
    of the ranges before it, which are as many as shuffle partitions.
    """
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    here = dealt.withColumn("_here", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return here.join(before.select("_part", "_before"), "_part").withColumn(out, F.col("_here") + F.col("_before")).drop("_part", "_here", "_before")


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """(reason, n): in how many rows each reason of the array stands."""
    return df.select(F.explode(F.array_distinct(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def level_histogram(df: DataFrame, kind: str, fields: Sequence[str]) -> DataFrame:
    """(kind, field, level, n): values of several level columns counted in one pass."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("level")) for f in fields])
    return df.select(kind, F.explode(rows).alias("r")).groupBy(kind, "r.field", "r.level").agg(F.count("*").alias("n"))


#: Width of the blocks of offset_histogram(), a power of two.
_BLOCK = 1 << 16


def _correlate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k, n) of pairs of blocks (d, xs, xn, ys, yn) in the order of d: offsets of sparse pairs one by one, of dense ones by a transform.

    Products of the transforms are added up for all pairs of one d, as long as the bound of their error shows that the counts are exact.
    """
    size, d, total, error = 2 * _BLOCK, None, None, 0.0

    def told() -> Iterator[pd.DataFrame]:
        if total is not None:
            n = np.rint(np.fft.irfft(total, size)).astype(np.int64)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"k": d * _BLOCK + np.where(at < _BLOCK, at, at - size), "n": n[at]})

    for b in batches:
        for r in b.itertuples(index=False):
            if d != r.d:
                yield from told()
                d, total, error = r.d, None, 0.0
            xn, yn = np.asarray(r.xn, dtype=float), np.asarray(r.yn, dtype=float)
            more = 64 * np.finfo(float).eps * math.log2(size) * math.sqrt(float(xn @ xn) * float(yn @ yn))
            if len(r.xs) * len(r.ys) <= 4 * _BLOCK or more > 0.1:
                for i in range(0, len(r.xs), 64):  # 64 * _BLOCK at most
                    k = np.subtract.outer(np.asarray(r.xs[i : i + 64], dtype=np.int64), np.asarray(r.ys, dtype=np.int64)) + _BLOCK
                    n = np.zeros(size, dtype=np.int64)
                    np.add.at(n, k.ravel(), np.multiply.outer(np.asarray(r.xn[i : i + 64]), np.asarray(r.yn)).ravel())
                    at = np.flatnonzero(n)
                    yield pd.DataFrame({"k": d * _BLOCK + at - _BLOCK, "n": n[at]})
                continue
            if error + more > 0.1:
                yield from told()
                total, error = None, 0.0
            x, y = np.zeros(size), np.zeros(size)
            x[r.xs], y[r.ys] = xn, yn
            product = np.fft.rfft(x) * np.conj(np.fft.rfft(y))
            total, error = product if total is None else total + product, error + more
    yield from told()


def offset_histogram(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(k, n): how often a - b = k among rows of one key; a null makes k null.

    Both sides are counted by (key, value). Whole numbers are cut into blocks of neighbouring values, and pairs of blocks are
    correlated: two blocks that hold many values cost one product of their transforms, not a row for each pair of values.
    """
    if {dict(left.dtypes)[a], dict(right.dtypes)[b]} - {"tinyint", "smallint", "int", "bigint"}:
        x, y = left.groupBy(key, a).agg(F.count("*").alias("_na")), right.groupBy(key, b).agg(F.count("*").alias("_nb"))
        return x.join(y, key).groupBy((F.col(a) - F.col(b)).alias("k")).agg(F.sum(F.col("_na") * F.col("_nb")).alias("n"))

    def counted(df: DataFrame, value: str, n: str) -> DataFrame:
        return materialize(df.filter(F.col(key).isNotNull()).groupBy(key, F.col(value).cast("long").alias("v")).agg(F.count("*").alias(n)), "counted")

    def blocks(df: DataFrame, n: str, side: str) -> DataFrame:
        places = F.array_sort(F.collect_list(F.struct(F.col("v").bitwiseAND(F.lit(_BLOCK - 1)).cast("int").alias("s"), F.col(n).alias("n"))))
        got = df.filter("v is not null").groupBy(key, F.shiftright("v", _BLOCK.bit_length() - 1).alias(f"b{side}")).agg(places.alias("p"))
        return got.select(key, f"b{side}", F.col("p.s").alias(f"{side}s"), F.col("p.n").alias(f"{side}n"))

    x, y = counted(left, a, "_na"), counted(right, b, "_nb")
    # few rows a key, of up to a block each, dealt by key and blocks before they are paired
    pairs = blocks(x, "_na", "x").join(blocks(y, "_nb", "y"), key).withColumn("d", F.col("bx") - F.col("by"))
    dealt = pairs.select("d", "xs", "xn", "ys", "yn", F.pmod(F.hash(key, "bx"), F.lit(8)).alias("_deal"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "d", "_deal").sortWithinPartitions("d").drop("_deal")
    whole = dealt.mapInPandas(_correlate, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    total = lambda df, n: df.groupBy(key).agg(F.sum(n).alias(n), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col(n))), F.lit(0)).alias(f"{n}_known"))
    nulls = total(x, "_na").join(total(y, "_nb"), key).agg(F.sum(F.col("_na") * F.col("_nb") - F.col("_na_known") * F.col("_nb_known")).alias("n"))
    return whole.union(nulls.filter("n > 0").select(F.lit(None).cast("long").alias("k"), "n"))


def prefix_counts(df: DataFrame, text: str, mark: str) -> DataFrame:
    """(prefix, n): rows by what stands before the first mark."""
    return df.groupBy(F.substring_index(text, mark, 1).alias("prefix")).agg(F.count("*").alias("n"))


def grouped_rollup(df: DataFrame, key: str, flag: str, value: str, order: str) -> DataFrame:
    """(key, n, n_flagged, first): rows and flagged rows of each key, and its first value by order."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"), F.min_by(value, order).alias("first"))


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(lo, hi, n): rows by their unordered pair; rows whose ends are equal are left out."""
    return df.filter(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.count("*").alias("n"))


def displayed_groups(df: DataFrame, shown: str, raw: str) -> DataFrame:
    """(name, n): rows by the displayed name, so that synonyms meet; ? without any name."""
    name = F.coalesce(F.when(F.col(shown) != "", F.col(shown)), F.when(F.col(raw) != "", F.col(raw)), F.lit("?"))
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
