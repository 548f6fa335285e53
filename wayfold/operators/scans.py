"""Running values over an order, whatever the size of a part.

A window by part puts each part into one task. Here rows are dealt into ranges of (part, order); a
range is scanned by itself, and what the ranges before it of the same part hold is one row a range
and part, which is scanned in turn and joined back. So one part with all rows is as parallel as many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.storage import materialize


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _dealt(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, written, with _range, in ranges of part and order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *part, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _with_before(dealt: DataFrame, part: Sequence[str], summary: Sequence[Column], carry) -> DataFrame:
    """dealt with _before: carry(window) over the summaries of the part's earlier ranges, null in its first one."""
    each = dealt.groupBy(*part, "_range").agg(*summary)
    # a row for each part and range: a part has as many as there are ranges at most
    earlier = W.partitionBy(*part).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    told = each.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], F.col("_range").alias("_r"), carry(earlier).alias("_before")).filter("_before is not null")
    same = dealt["_range"] == told["_r"]
    for i, c in enumerate(part):
        same = same & dealt[c].eqNullSafe(told[f"_k{i}"])
    return dealt.join(told, same, "left").drop("_r", *[f"_k{i}" for i in range(len(part))])


def carry_forward(df: DataFrame, value: str, part, order) -> DataFrame:
    """df with value replaced by its last non-null value so far within the part; null before the first.

    part and order name columns; null parts are one part; the order should be total, else equal rows come in any order.
    """
    part, order = _names(part), _names(order)
    dealt = _dealt(df.withColumn("_value", F.col(value)), part, order)
    key = F.struct(*order)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), key)).alias("_last")
    whole = _with_before(dealt, part, [last], lambda w: F.last("_last", ignorenulls=True).over(w))
    here = W.partitionBy("_range", *part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return whole.withColumn(value, F.coalesce(F.last("_value", ignorenulls=True).over(here), "_before")).select(*df.columns)


def count_before(df: DataFrame, valid: Column, part, order, out: str = "ordinal") -> DataFrame:
    """df with out: how many valid rows of the part come before this one. A null condition counts as false."""
    part, order = _names(part), _names(order)
    dealt = _dealt(df.withColumn("_valid", F.coalesce(valid.cast("long"), F.lit(0)).cast("long")), part, order)
    whole = _with_before(dealt, part, [F.sum("_valid").alias("_sum")], lambda w: F.sum("_sum").over(w))
    here = W.partitionBy("_range", *part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_valid").over(here), F.lit(0)) + F.coalesce("_before", F.lit(0))
    kept = [c for c in df.columns if c != out]
    return whole.withColumn(out, total.cast("long")).select(*kept, out)


def running_sum(df: DataFrame, value: Column, part, order, out: str = "total") -> DataFrame:
    """df with out: the sum of value up to and with this row within the part; nulls count as nothing."""
    part, order = _names(part), _names(order)
    dealt = _dealt(df.withColumn("_value", value), part, order)
    whole = _with_before(dealt, part, [F.sum("_value").alias("_sum")], lambda w: F.sum("_sum").over(w))
    here = W.partitionBy("_range", *part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = F.sum("_value").over(here)
    total = F.when(own.isNull() | F.col("_before").isNull(), F.coalesce(own, "_before")).otherwise(own + F.col("_before"))
    kept = [c for c in df.columns if c != out]
    return whole.withColumn(out, total).select(*kept, out)
