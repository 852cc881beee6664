"""The model queries hand the reference's trees, grids, folds, runs and lags to the operators."""

import inspect

import pytest

from millrace.operators import cluster as cl
from millrace.operators import forecast as fc
from millrace.operators import margin as mg
from millrace.operators import resample as rs
from millrace.operators import trees as tr
from millrace.plans.catalog import queries

C = list(range(1, 10))
GAMMAS = [0.001, 0.01, 0.1, 1, 3, 5, 7, 10]
# Query: the operator, the values it must get, and the number of folds of the rows it must get.
WANTED = {
    "boost_reg": (tr, "boost_reg", {"n_trees": 100, "l1s": [1e-5, 1e-2, 0.1, 1, 100]}, 5),
    "gbt_reg": (tr, "gbt_reg", {"n_trees": 100}, None),
    "gbt_clf": (tr, "gbt_clf", {"n_trees": 100}, None),
    "boost_clf_folds": (tr, "boost_folds", {"n_trees": 10, "depth": 6}, 10),
    "boost_smote_folds": (tr, "boost_folds", {"n_trees": 10, "depth": 6}, 10),
    "boost_smote_before_folds": (tr, "boost_folds", {"n_trees": 10, "depth": 6}, 10),
    "rbf_svm": (mg, "rbf_svm", {"cs": C, "gammas": GAMMAS, "n_features": 256}, 10),
    "rbf_svr": (mg, "rbf_svr", {"cs": [0.5, 1.0, 1.5], "n_features": 256}, 5),
    "classifier_chain": (mg, "classifier_chain", {"c": 6.0, "gamma": 3.0, "n_features": 256}, None),
    "linear_svm_l1_smote": (mg, "linear_svm_l1", {"cs": C}, 10),
    "kmeans_sweep": (cl, "kmeans_sweep", {"ks": list(range(2, 50))}, None),
    "kmeans_repeat": (cl, "kmeans_runs", {"seeds": list(range(50))}, None),
    "lag_forecast_boosted": (fc, "lag_forecast", {"lookback": 120, "kw": {"n_trees": 100, "depth": 3}}, None),
}


class Called(Exception):
    """Carries what an operator was called with."""


@pytest.mark.parametrize("name", sorted(WANTED))
def test_reference_values(spark, monkeypatch, name):
    module, operator, wanted, folds = WANTED[name]
    signature = inspect.signature(getattr(module, operator))

    def called(*args, **kw):
        got = signature.bind(*args, **kw)
        got.apply_defaults()
        raise Called(got.arguments)

    monkeypatch.setattr(module, operator, called)
    with pytest.raises(Called) as found:
        queries()[name](spark, "/root/testdata/sf0.001")
    got = found.value.args[0]
    assert {k: list(got[k]) if isinstance(got[k], (tuple, range)) else got[k] for k in wanted} == wanted
    if folds:
        assert got["df"].select(got["fold"]).distinct().count() == folds


def test_post_direction_is_whole(spark):
    """Eleven models, both labels where the reference has both, scored on both parts."""
    rows = queries()["post_direction"](spark, "/root/testdata/sf0.001").collect()
    both = {"gaussian_nb", "logistic", "linear_svm_l1"}
    one = {"rf_clf", "extra_trees_clf", "gbt_clf", "knn_regress", "rbf_svr", "rf_reg", "extra_trees_reg", "gbt_reg"}
    assert sorted((r["label"], r["model"], r["is_test"]) for r in rows) == sorted(
        (label, m, part) for part in (0, 1) for label, names in (("up_3", both), ("up_5", both | one)) for m in names)
    for r in rows:
        assert r["accuracy"] == pytest.approx((r["tn"] + r["tp"]) / (r["tn"] + r["fp"] + r["fn"] + r["tp"]))
