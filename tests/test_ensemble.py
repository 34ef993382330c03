"""The booster, its explanations, calibration and metrics."""

import math

import numpy as np
import pytest

from cadence.operators.booster import fit_booster, fit_calibrator, shap_values, sigmoid
from cadence.operators.ensemble import AutomationEnsemble, EnsembleConfig, NotTrainableError


def planted(n=240, seed=3):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = np.column_stack([y * 2.0 + rng.normal(0, 0.7, n), rng.normal(0, 1, n), -y + rng.normal(0, 1, n), rng.normal(0, 1, n)])
    x[rng.random(x.shape) < 0.15] = np.nan
    return x, y


def test_booster_learns_and_shap_adds_up():
    x, y = planted()
    model = fit_booster(x, y, iterations=20, leaves=6)
    raw = model.raw(x)
    assert (sigmoid(raw)[y == 1].mean() - sigmoid(raw)[y == 0].mean()) > 0.3
    values, expected = shap_values(model, x)
    assert np.allclose(values.sum(1) + expected, raw)
    assert np.abs(values).mean(0).argmax() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=300)
    y = (rng.random(300) < sigmoid(2 * raw)).astype(int)
    for method in ("isotonic", "sigmoid"):
        p = fit_calibrator(raw, y, method)(np.linspace(-3, 3, 50))
        assert (np.diff(p) >= -1e-12).all() and 0 <= p.min() and p.max() <= 1


def test_fit_card_and_guards(spark):
    x, y = planted()
    rows = [(f"a{k:03d}", *(None if math.isnan(v) else float(v) for v in r), None) for k, r in enumerate(x)]
    features = spark.createDataFrame(rows, "account_id string, f0 double, noise double, f2 double, n3 double, empty double")
    labels = spark.createDataFrame([(f"a{k:03d}", "automated" if t else "organic", "d") for k, t in enumerate(y)] + [("zz", "unknown", "d")], "account_id string, label string, dataset string")
    model = AutomationEnsemble(EnsembleConfig(iterations=15, n_folds=3, leaves=6)).fit(features, labels)
    assert model.card["n_train"] == 240 and model.card["dropped_features"] == ["empty"]
    assert model.card["metrics"]["roc_auc"] > 0.85
    p = model.predict_proba(features).toPandas()
    assert p["probability"].between(0, 1).all() and (p["low"] <= p["high"]).all()
    importance = [r["feature"] for r in model.global_importance(features).collect()]
    assert importance[0] == "f0"
    with pytest.raises(ValueError):
        model.predict_proba(features.drop("f2"))
    with pytest.raises(RuntimeError):
        AutomationEnsemble().predict_proba(features)
    with pytest.raises(NotTrainableError):
        AutomationEnsemble().fit(features, labels.filter("label = 'organic'"))
