"""Exact, interpolated quantiles of whole numbers, from counts of their values.

An aggregate would hold all different values of a key in one buffer. Here values are first counted by ranges of 2^RANGE of
them, which tells the ranges that hold the wanted places; only values of those are then put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = 16


def of_counts(counts: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """The keys and a column for each wanted quantile (by name) of counts (keys, value bigint, n); null values don't count.

    Keys compare null-safe; a key with null values alone has no row."""
    rows = counts.where(F.col("value").isNotNull())
    ranges = rows.groupBy(*keys, F.shiftright("value", RANGE).alias("_range")).agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*keys).orderBy("_range")
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranges = ranges.withColumn("_all", total).withColumn("_before", F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    places = {name: (F.col("_all") - 1) * F.lit(q) for name, q in wanted.items()}
    low = {name: F.floor(p) for name, p in places.items()}
    high = {name: F.ceil(p) for name, p in places.items()}
    holds = lambda first, n, place: (first <= place) & (place < first + n)
    some = reduce(lambda a, b: a | b, [holds(F.col("_before"), F.col("n"), p) for p in [*low.values(), *high.values()]])
    chosen = ranges.where(some).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), "_all", "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.shiftright("value", RANGE) == F.col("_r"))
    near = rows.join(chosen, same)
    within = Window.partitionBy(*keys, "_r").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_first", F.col("_before") + F.sum("n").over(within) - F.col("n"))
    at = lambda place: F.max(F.when(holds(F.col("_first"), F.col("n"), place), F.col("value")))
    parts = near.groupBy(*keys).agg(F.max("_all").alias("_all"), *(at(low[n]).alias(f"_low_{i}") for i, n in enumerate(wanted)), *(at(high[n]).alias(f"_high_{i}") for i, n in enumerate(wanted)))
    value = lambda i, name: F.col(f"_low_{i}") + (F.col(f"_high_{i}") - F.col(f"_low_{i}")) * (places[name] - low[name])
    return parts.select(*keys, *(value(i, name).cast("double").alias(name) for i, name in enumerate(wanted)))
