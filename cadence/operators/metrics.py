"""Evaluation of probabilities: calibration, ranking, histograms, and per-class figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.plans.order import percentiles, running

BINS = 10


def _upper_bin(p: Column, bins: int) -> Column:
    """Number of the bin (lo, hi] of a probability, by its edges; 0 has none."""
    out = F.when(p <= 0, None)
    for k in range(bins):
        out = out.when(p <= (k + 1) / bins, k)
    return out


def reliability(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """bin, n, predicted, observed of (target, probability), for bins that hold any."""
    binned = rows.withColumn("bin", _upper_bin(F.col("probability"), bins)).filter("bin is not null")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("predicted"), F.avg(F.col("target").cast("double")).alias("observed"))


def expected_calibration_error(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """One row: the mean distance of observed and predicted, weighted by the share of all rows."""
    parts = reliability(rows, bins).agg(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))).alias("s")).withColumn("_one", F.lit(1))
    total = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return parts.join(total, "_one").select(F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("ece"))


def ranking(rows: DataFrame) -> DataFrame:
    """One row: roc_auc, average_precision, brier, base_rate of (target, probability).

    Rows are counted by distinct probability first, so the running sums are over those, not rows.
    """
    t = F.col("target").cast("double")
    counts = rows.groupBy("probability").agg(F.sum(t).alias("pos"), F.sum(1 - t).alias("neg"), F.sum((F.col("probability") - t) * (F.col("probability") - t)).alias("loss"))
    run = running(counts, [F.desc("probability")], {"tp": F.col("pos"), "fp": F.col("neg")})
    # A negative at this probability is outranked by the positives above it, and ties count half.
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    sums = run.agg(auc.alias("wins"), ap.alias("ap"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum("loss").alias("loss"))
    return sums.select(
        F.try_divide("wins", F.col("p") * F.col("n")).alias("roc_auc"),
        F.try_divide("ap", "p").alias("average_precision"),
        F.try_divide("loss", F.col("p") + F.col("n")).alias("brier"),
        F.try_divide("p", F.col("p") + F.col("n")).alias("base_rate"),
    )


def per_class(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """class, precision, recall, f1, support at a cut; a quotient by 0 is 0."""
    said = (F.col("probability") >= cut).cast("int")
    out = rows.withColumn("said", said).withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
    sums = out.groupBy("class").agg(
        F.count_if((F.col("said") == F.col("class")) & (F.col("target") == F.col("class"))).alias("tp"),
        F.count_if(F.col("said") == F.col("class")).alias("claimed"),
        F.count_if(F.col("target") == F.col("class")).alias("support"),
    )
    p, r = F.coalesce(F.try_divide("tp", "claimed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return sums.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def histogram(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """bin, n of probabilities in [lo, hi), the last bin closed; empty bins count 0."""
    at = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    found = rows.filter("probability is not null").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def probability_summary(rows: DataFrame) -> DataFrame:
    """One row: n, p10, median, p90 and the mean spread, where there is one."""
    spread = F.avg("spread") if "spread" in rows.columns else F.lit(None).cast("double")
    one = rows.agg(F.lit("p").alias("of"), F.count("probability").alias("n"), spread.alias("mean_spread"))
    q = percentiles(rows.select(F.lit("p").alias("of"), "probability"), ["of"], "probability", (0.1, 0.5, 0.9))
    both = one.join(q, "of", "left")
    return both.select("n", *(F.get("q", k).alias(c) for k, c in enumerate(("p10", "median", "p90"))), "mean_spread")
