"""Calibrated probabilities from labelled accounts, with nested out-of-fold evaluation and a model card.

Training rows are labelled accounts: their number is checked against a bound before they are
collected.  Fits run on the executors, one per fold; scoring maps over all accounts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators import metrics
from cadence.operators.booster import Booster, Calibrator, fit_booster, fit_calibrator, shap_values
from cadence.operators.labels import TrainingTask, measurable, training_rows

#: Limits for warnings (fixed values).
MINORITY, ECE, SPREAD = 0.2, 0.1, 1e-6
#: Labelled accounts that one fit may hold.
MOST_ROWS = 2_000_000


#: Published with every table of probabilities.
SCORE_CAVEAT = "A probability says how accounts with such features were labelled; it is no finding about an account."
VERSION = "0.2.0"


class NotTrainableError(ValueError):
    """Too few labelled accounts of a class, or nothing measured."""


@dataclass(frozen=True)
class EnsembleConfig:
    method: str = "isotonic"
    n_folds: int = 5
    iterations: int = 200
    rate: float = 0.05
    leaves: int = 31
    min_leaf: int = 5
    min_per_class: int = 25
    seed: int = 20240301

    def __post_init__(self) -> None:
        if self.method not in ("isotonic", "sigmoid") or self.n_folds < 2:
            raise ValueError("method is isotonic or sigmoid, and there are two folds at least")

    def booster(self) -> dict:
        return {"iterations": self.iterations, "rate": self.rate, "leaves": self.leaves, "least": self.min_leaf}


def fold_numbers(y: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """A fold for each row, each class spread evenly."""
    out = np.empty(len(y), np.int64)
    rng = np.random.default_rng(seed)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        out[rng.permutation(rows)] = np.arange(len(rows)) % folds
    return out


Members = list[tuple[Booster, Calibrator]]


def fit_members(x: np.ndarray, y: np.ndarray, folds: int, seed: int, config: EnsembleConfig) -> Members:
    """One booster per fold, calibrated on the rows that its fit left out."""
    number = fold_numbers(y, folds, seed)
    out = []
    for k in range(folds):
        booster = fit_booster(x[number != k], y[number != k], **config.booster())
        held = number == k
        out.append((booster, fit_calibrator(booster.raw(x[held]), y[held], config.method)))
    return out


def probabilities(members: Members, x: np.ndarray) -> np.ndarray:
    """A column for each member."""
    return np.column_stack([calibrate(booster.raw(x)) for booster, calibrate in members])


@dataclass
class AutomationEnsemble:
    config: EnsembleConfig = field(default_factory=EnsembleConfig)
    task: TrainingTask = field(default_factory=TrainingTask)
    names: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    members: Members = field(default_factory=list)
    card: dict = field(default_factory=dict)

    def fit(self, features: DataFrame, labels: DataFrame) -> AutomationEnsemble:
        """Fit on the labelled rows, evaluate out of fold, and write the card."""
        spark = features.sparkSession
        columns = [c for c, t in features.dtypes if t == "double" and c != "account_id"]
        rows = training_rows(features, labels, columns, self.task).cache()
        excluded = {r["status"]: r["n"] for r in rows.filter("status is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        usable = rows.filter("status is null")
        counts = {r["target"]: r["n"] for r in usable.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
        if set(counts) != {0, 1} or min(counts.values()) < self.config.min_per_class:
            raise NotTrainableError(f"either class needs {self.config.min_per_class} accounts; there are {counts}")
        if sum(counts.values()) > MOST_ROWS:
            raise NotTrainableError(f"a fit holds {MOST_ROWS} rows at most; sample the labels")
        self.names, self.dropped = measurable(usable, columns)
        table = usable.select("account_id", "target", *self.names).toPandas().sort_values("account_id", ignore_index=True)
        rows.unpersist()
        x, y = table[self.names].to_numpy(float), table["target"].to_numpy(int)
        folds = min(self.config.n_folds, *counts.values())
        held = self._out_of_fold(spark, x, y, folds)
        self.members = fit_members(x, y, folds, self.config.seed, self.config)
        self.card = self._card(spark, y, held, counts, excluded, labels, probabilities(self.members, x))
        return self

    def _out_of_fold(self, spark, x: np.ndarray, y: np.ndarray, folds: int) -> np.ndarray:
        """Probabilities of rows that neither a fit nor its calibration has seen; a task per fold."""
        number = fold_numbers(y, folds, self.config.seed)
        shared, config = spark.sparkContext.broadcast((x, y, number)), self.config

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, y, number = shared.value
            for frame in frames:
                for k in frame["id"]:
                    inner = number != k
                    members = fit_members(x[inner], y[inner], min(folds, *np.bincount(y[inner], minlength=2)), config.seed + 1, config)
                    held = np.flatnonzero(~inner)
                    yield pd.DataFrame({"row": held, "probability": probabilities(members, x[held]).mean(1)})

        found = spark.range(0, folds, 1, folds).mapInPandas(run, "row long, probability double").toPandas()
        out = np.empty(len(y))
        out[found["row"].to_numpy()] = found["probability"].to_numpy()
        return out

    def _card(self, spark, y: np.ndarray, held: np.ndarray, counts: dict, excluded: dict, labels: DataFrame, fitted: np.ndarray) -> dict:
        scored = spark.createDataFrame(pd.DataFrame({"target": y.astype("int32"), "probability": held}))
        ece = metrics.expected_calibration_error(scored).first()["ece"]
        datasets = sorted(r["dataset"] for r in labels.select("dataset").distinct().collect()) if "dataset" in labels.columns else []
        minority = min(counts.values()) / sum(counts.values())
        warnings = ["members of one network may be in different folds, so figures can be too good for new networks"]
        if float((fitted.max(0) - fitted.min(0)).max()) < SPREAD:
            warnings.append("degenerate: all accounts get the same probability")
        if self.dropped:
            warnings.append(f"never measured and left out: {', '.join(self.dropped)}")
        if minority < MINORITY:
            warnings.append(f"the smaller class is {minority:.1%} of the rows")
        if ece > ECE:
            warnings.append(f"calibration error {ece:.3f}: the probabilities are not to be taken at face value")
        if len(datasets) > 1:
            warnings.append("labels of several datasets were mixed")
        methods = sorted(r["method"] for r in labels.select("method").distinct().collect() if r["method"]) if "method" in labels.columns else []
        return {
            "version": VERSION,
            "trained_at": datetime.now(UTC).isoformat(timespec="seconds"),
            "label_methods": methods,
            "task": self.task.name,
            "config": asdict(self.config),
            "features": self.names,
            "dropped_features": self.dropped,
            "n_train": int(len(y)),
            "class_counts": {str(k): int(v) for k, v in sorted(counts.items())},
            "excluded": excluded,
            "datasets": datasets,
            "metrics": metrics.ranking(scored).first().asDict() | {"ece": ece},
            "per_class": [r.asDict() for r in metrics.per_class(scored).orderBy("class").collect()],
            "reliability": [r.asDict() for r in metrics.reliability(scored).orderBy("bin").collect()],
            "warnings": warnings,
        }

    def _aligned(self, features: DataFrame) -> DataFrame:
        if not self.members:
            raise RuntimeError("fit the ensemble first")
        if missing := [n for n in self.names if n not in features.columns]:
            raise ValueError(f"features that the model needs are missing: {', '.join(missing)}")
        return features.select("account_id", *(F.col(n).cast("double").alias(n) for n in self.names))

    def predict_proba(self, features: DataFrame) -> DataFrame:
        """account_id, probability (the members' mean), low, high and spread; no verdict."""
        shared = features.sparkSession.sparkContext.broadcast(self.members)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
                    p = probabilities(shared.value, x)
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in (p.mean(1), p.min(1), p.max(1), p.max(1) - p.min(1)))], names=["account_id", "probability", "low", "high", "spread"])

        return self._aligned(features).mapInArrow(run, "account_id string, probability double, low double, high double, spread double")

    def explain(self, features: DataFrame) -> DataFrame:
        """account_id, a contribution in log-odds per feature, and the expected value."""
        shared, names = features.sparkSession.sparkContext.broadcast(self.members), [*self.names, "expected"]
        schema = T.StructType([T.StructField("account_id", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
                    parts = [shap_values(booster, x) for booster, _ in shared.value]
                    mean, base = sum(p for p, _ in parts) / len(parts), sum(e for _, e in parts) / len(parts)
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in mean.T), pa.array(np.full(len(x), base))], names=["account_id", *names])

        return self._aligned(features).mapInArrow(run, schema)

    def global_importance(self, features: DataFrame) -> DataFrame:
        """feature, importance: the mean absolute contribution, largest first."""
        one = self.explain(features).agg(*(F.avg(F.abs(F.col(n))).alias(n) for n in self.names))
        return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in self.names))).alias("s")).select("s.*").orderBy(F.desc("importance"), "feature")
