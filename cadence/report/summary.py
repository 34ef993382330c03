"""Aggregates for reports: feature quantiles with coverage, and cluster cards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.plans.order import percentiles

PERCENTILES = (0.1, 0.5, 0.9)
#: A quiet share above this is counted among the restless (fixed value).
RESTLESS = 0.15


def summarise_features(features: DataFrame, names: Iterable[str]) -> DataFrame:
    """feature, measured, missing, coverage, p10, median, p90; names that are no column are left out.

    Percentiles interpolate linearly and leave NULLs out.
    """
    names = [n for n in names if n in features.columns]
    stats = [F.struct(F.lit(n).alias("feature"), F.count(n).alias("measured"), (F.count(F.lit(1)) - F.count(n)).alias("missing")).alias(n) for n in names]
    rows = features.agg(*stats).select(F.explode(F.array(*(F.col(n) for n in names))).alias("s")).select("s.*")
    long = features.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("s")).select("s.*")
    total = F.col("measured") + F.col("missing")
    return rows.join(percentiles(long, ["feature"], "value", PERCENTILES), "feature", "left").select(
        "feature",
        "measured",
        "missing",
        F.when(total > 0, F.col("measured") / total).alias("coverage"),
        *(F.get("q", k).alias(c) for k, c in enumerate(("p10", "median", "p90"))),
    )


def cluster_hours(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """cluster_id and its posts by hour of the day, from (account_id, cluster_id) and profiles."""
    hours = members.join(profiles.select("account_id", "hour_histogram"), "account_id").select("cluster_id", F.posexplode("hour_histogram").alias("hour", "n"))
    summed = hours.groupBy("cluster_id", "hour").agg(F.sum("n").alias("n"))
    return summed.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "n"))), lambda x: x["n"]).alias("hours"))


def cluster_cards(clusters: DataFrame, members: DataFrame, features: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """One row per cluster: its numbers, medians of its members' features, and hours."""
    joined = members.join(features, "account_id", "left")
    have = set(features.columns)
    stats = [F.count(F.lit(1)).alias("n_members")]
    if "acct_age_days" in have:
        stats.append(F.median("acct_age_days").alias("median_age_days"))
    if "temp_circadian_entropy" in have:
        stats.append(F.median("temp_circadian_entropy").alias("median_circadian_entropy"))
    if "temp_quiet_hours_share" in have:
        stats += [F.count_if(F.col("temp_quiet_hours_share") > RESTLESS).alias("restless_members"), F.count("temp_quiet_hours_share").alias("measured_members")]
    cards = clusters.join(joined.groupBy("cluster_id").agg(*stats), "cluster_id", "left")
    return cards if profiles is None else cards.join(cluster_hours(members, profiles), "cluster_id", "left")


def round_half_even(value: float | None, digits: int = 4) -> float | None:
    """Rounding for documents, on the driver: Python's, on the binary value."""
    return None if value is None else round(value, digits)
