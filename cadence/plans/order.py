"""Running sums, numbers and percentiles over a total order, without a task that sees all rows.

Rows are dealt by ranges of the order, summed up within each range, and shifted by the sums of the
ranges before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.plans.lineage import cut

RANGE = "_range"


def running(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with the sums of all rows up to each one, itself included; ties of the order are arbitrary.

    ``_range`` and the names of the sums must not be columns of ``df``.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))
    so_far = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row for each range, so this window is as long as there are tasks.
    ahead = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(RANGE).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = totals.select(RANGE, *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}") for n in sums))
    found = dealt.join(F.broadcast(before), RANGE)
    return found.select(*df.columns, *((F.sum(c).over(so_far) + F.col(f"_{n}")).alias(n) for n, c in sums.items()))


def numbered(df: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """``df`` with the number of each row in the order, from 0."""
    found = running(df, order, {into: F.lit(1).cast("long")})
    return found.withColumn(into, F.col(into) - 1)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """keys and q, the linearly interpolated quantiles of each key's values; keys without a value are missing.

    Equal values of a key are counted before they are ordered.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = running(counts, [*map(F.col, keys), F.col("_value")], {"_end": F.col("_n")})
    bounds = ordered.groupBy(*keys).agg(F.min(F.col("_end") - F.col("_n")).alias("_low"), F.sum("_n").alias("_all"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("place")) for k, q in enumerate(quantiles)))).alias("w")
    near = ordered.join(bounds.select(*keys, "_low", wanted), list(keys))
    # The value at a rank is that of the run of equal values which the rank falls in.
    start, end, place = F.col("_end") - F.col("_n") - F.col("_low"), F.col("_end") - F.col("_low"), F.col("w.place")
    at_low, at_high = ((start <= rank) & (rank < end) for rank in (F.floor(place), F.ceil(place)))
    found = near.filter(at_low | at_high).groupBy(*keys, "w").agg(F.max(F.when(at_low, F.col("_value"))).alias("a"), F.max(F.when(at_high, F.col("_value"))).alias("b"))
    share = place - F.floor(place)
    each = found.select(*keys, F.struct(F.col("w.k").alias("k"), (F.col("a") + (F.col("b") - F.col("a")) * share).alias("v")).alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("q"))
