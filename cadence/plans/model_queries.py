"""Registered queries of learning, reports and catalogues, with SQL for what they must come to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import account, ensemble, labels, temporal
from cadence.operators.booster import fit_booster, fit_calibrator, shap_values
from cadence.plans import bindings as b
from cadence.plans.registry import query, rounded
from cadence.report import summary
from cadence.report.build import all_features, registry

#: Rows that a query trains on are labelled customers: their number is bounded like that of an ensemble.
SMALL = ensemble.EnsembleConfig(method="sigmoid", n_folds=3, iterations=20, leaves=7)


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two features; those without debts are automated, and nobody has ``empty``."""
    k = F.col("c_custkey")
    return b.read(spark, sf_dir, "customer").select(
        k.cast("string").alias("account_id"),
        F.when(F.col("c_nationkey") != 3, F.floor(F.col("c_acctbal") / 100).cast("double")).alias("balance"),
        (k % 13).cast("double").alias("other"),
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("c_mktsegment") == "BUILDING", "unknown").when(F.col("c_acctbal") >= 0, "automated").otherwise("organic").alias("label"),
        F.lit("balances").alias("dataset"),
        F.lit("heuristic").alias("method"),
    )


def fitted(spark: SparkSession, sf_dir: str) -> tuple[ensemble.AutomationEnsemble, DataFrame]:
    rows = balances(spark, sf_dir)
    features = rows.select("account_id", "balance", "other", "empty")
    model = ensemble.AutomationEnsemble(SMALL).fit(features, rows.select("account_id", "label", "dataset", "method"))
    return model, features


_TASK = "FROM customer WHERE c_mktsegment <> 'BUILDING'"


@query(
    f"""SELECT 'n_train' AS what, (SELECT count(*) {_TASK}) AS n UNION ALL SELECT 'positive', (SELECT count(*) {_TASK} AND c_acctbal >= 0) UNION ALL SELECT 'negative', (SELECT count(*) {_TASK} AND c_acctbal < 0)
 UNION ALL SELECT 'outside_task', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'features', 2 UNION ALL SELECT 'dropped', 1 UNION ALL SELECT 'datasets', 1 UNION ALL SELECT 'label_methods', 1"""
)
def model_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = fitted(spark, sf_dir)[0].card
    rows = {"n_train": card["n_train"], "positive": card["class_counts"]["1"], "negative": card["class_counts"]["0"], "outside_task": card["excluded"][labels.OUTSIDE]}
    rows |= {"features": len(card["features"]), "dropped": len(card["dropped_features"]), "datasets": len(card["datasets"]), "label_methods": len(card["label_methods"])}
    return spark.createDataFrame(list(rows.items()), "what string, n long")


@query("SELECT c_custkey::VARCHAR AS account_id, c_acctbal >= 0 AS likely, true AS bounded FROM customer WHERE c_nationkey <> 3")
def predicted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature decides the class, so every measured account falls on its side."""
    model, features = fitted(spark, sf_dir)
    found = model.predict_proba(features.filter("balance is not null"))
    bounded = (F.col("low") <= F.col("probability")) & (F.col("probability") <= F.col("high")) & F.col("probability").between(0, 1)
    return found.select("account_id", (F.col("probability") >= 0.5).alias("likely"), bounded.alias("bounded"))


@query("SELECT c_custkey::VARCHAR AS account_id, 0.0::DOUBLE AS gap FROM customer")
def shap_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contributions of an account's features and the expected value add up to the mean raw score."""
    model, features = fitted(spark, sf_dir)
    members = spark.sparkContext.broadcast([booster for booster, _ in model.members])
    names = model.names

    def raw(frames):
        for frame in frames:
            scores = np.mean([m.raw(frame[names].to_numpy(float)) for m in members.value], axis=0)
            yield pd.DataFrame({"account_id": frame["account_id"], "raw": scores})

    scored = features.select("account_id", *names).mapInPandas(raw, "account_id string, raw double")
    total = sum((F.col(n) for n in names), F.col("expected"))
    return rounded(model.explain(features).join(scored, "account_id").select("account_id", (F.abs(F.round(total - F.col("raw"), 7)) + 0.0).alias("gap")))


@query("SELECT 1 AS rank, 'balance' AS feature UNION ALL SELECT 2, 'other'")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, features = fitted(spark, sf_dir)
    rows = model.global_importance(features).collect()
    return spark.createDataFrame([(k + 1, r["feature"]) for k, r in enumerate(rows)], "rank int, feature string")


@query(
    """WITH c AS (SELECT (s_acctbal > 0)::INTEGER AS target, count(*) AS n FROM supplier GROUP BY 1), f AS (SELECT unnest(range(4))::INTEGER AS fold)
SELECT target, fold, (n + 3 - fold) // 4 AS n FROM c, f"""
)
def fold_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds spread each class evenly."""
    y = np.array([int(r[0] > 0) for r in b.read(spark, sf_dir, "supplier").select("s_acctbal").collect()])
    found = pd.DataFrame({"target": y, "fold": ensemble.fold_numbers(y, 4, 7)}).value_counts().reset_index(name="n")
    return spark.createDataFrame(found).select(F.col("target").cast("int").alias("target"), F.col("fold").cast("int").alias("fold"), F.col("n").cast("long").alias("n"))


@query("SELECT (s_suppkey % 5)::INTEGER AS x, round(avg((s_suppkey // 5 % 5 < s_suppkey % 5)::INTEGER), 9) AS probability FROM supplier GROUP BY 1")
def isotonic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the observed shares rise with the scores, isotonic calibration returns these shares."""
    keys = np.array([r[0] for r in b.read(spark, sf_dir, "supplier").select("s_suppkey").collect()])
    score = (keys % 5).astype(float)
    calibrate = fit_calibrator(score, (keys // 5 % 5 < keys % 5).astype(int), "isotonic")
    return rounded(spark.createDataFrame([(int(x), float(calibrate(np.array([x]))[0])) for x in np.unique(score)], "x int, probability double"))


@query("SELECT s_suppkey, s_acctbal >= 0 AS said FROM supplier")
def boosted_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A booster learns a threshold, whatever rows lack the feature."""
    rows = b.read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").toPandas()
    x = np.floor(rows[["s_acctbal"]].to_numpy(float) / 100)
    y = (x[:, 0] >= 0).astype(int)
    model = fit_booster(x, y, iterations=30, rate=0.3, leaves=4, least=1)
    parts, base = shap_values(model, x)
    assert np.allclose(parts.sum(1) + base, model.raw(x))
    return spark.createDataFrame(pd.DataFrame({"s_suppkey": rows["s_suppkey"], "said": model.raw(x) > 0}))


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT user_id FROM events)) AS accounts, 22 AS features, (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 20)) AS measured")
def feature_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families side by side: every account once, and the names of the registry."""
    corpus = b.corpus(spark, sf_dir)
    found = all_features(corpus, account.AccountConfig(), temporal.TemporalConfig())
    row = found.agg(F.count(F.lit(1)).alias("accounts"), F.count("temp_circadian_entropy").alias("measured"))
    return row.select("accounts", F.lit(len(registry().names)).alias("features"), "measured")


@query(
    """WITH m AS (SELECT user_id, 'c' || (user_id % 4)::VARCHAR AS cluster_id FROM events GROUP BY 1), h AS (SELECT cluster_id, epoch_us(ts) // 3600000000 % 24 AS hour, count(*) AS n FROM events JOIN m USING (user_id) GROUP BY 1, 2),
 g AS (SELECT cluster_id, hour FROM (SELECT DISTINCT cluster_id FROM m), (SELECT unnest(range(24)) AS hour))
SELECT cluster_id, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY hour) AS hours FROM g LEFT JOIN h USING (cluster_id, hour) GROUP BY 1"""
)
def hours_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = b.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("account_id"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cluster_id")).distinct()
    found = summary.cluster_hours(members, temporal.profiles(b.event_posts(spark, sf_dir)))
    return found.select("cluster_id", F.array_join("hours", ",").alias("hours"))


@query(
    """SELECT c_mktsegment AS cluster_id, count(*) AS n_members, round(median(c_acctbal), 9) AS median_age_days, count(*) FILTER (WHERE c_acctbal / 10000 > 0.15) AS restless_members, count(c_acctbal) AS measured_members FROM customer GROUP BY 1"""
)
def members_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.read(spark, sf_dir, "customer").withColumn("account_id", F.col("c_custkey").cast("string"))
    features = rows.select("account_id", F.col("c_acctbal").alias("acct_age_days"), (F.col("c_acctbal") / 10000).alias("temp_quiet_hours_share"))
    members = rows.select("account_id", F.col("c_mktsegment").alias("cluster_id"))
    return rounded(summary.cluster_cards(members.select("cluster_id").distinct(), members, features))


@query("SELECT 0 AS mode, NULL::DOUBLE AS mean, NULL::DOUBLE AS middle FROM region WHERE r_regionkey = 0")
def empty_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and medians of nothing are missing, not 0."""
    none = b.read(spark, sf_dir, "customer").filter("c_custkey is null")
    return none.agg(F.lit(0).alias("mode"), F.avg("c_acctbal").alias("mean"), F.median("c_acctbal").alias("middle"))


@query("SELECT 'balance' AS name, true AS kept UNION ALL SELECT 'other', true UNION ALL SELECT 'empty', false")
def measurable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = labels.measurable(balances(spark, sf_dir), ["balance", "other", "empty"])
    return spark.createDataFrame([(n, n in kept) for n in (*kept, *dropped)], "name string, kept boolean")

