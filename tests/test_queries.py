"""Every query with SQL agrees with it on the smallest test data; every other one gives values that hold together."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from quarterdeck.operators.models import TIERS
from quarterdeck.plans import pipelines, problems, reference

from .conftest import DATA
from .helpers import same_as_sql

QUERIES = {**reference.QUERIES, **problems.QUERIES}
ORACLE = {**reference.ORACLE, **problems.ORACLE}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, duck, name):
    same_as_sql(QUERIES[name](spark, DATA), duck, ORACLE[name])


def _labels(t):
    known = t[t.risk_label != "insufficient_data"]
    assert len(t) and t.panel_id.is_unique and set(known.risk_label) <= set(TIERS) and known.raw_cluster_label.notna().all()
    assert t[t.risk_label == "insufficient_data"].raw_cluster_label.isna().all() and t.risk_score.dropna().between(0, 1).all()
    counts = t.groupby("rebal_date").training_window_n_rows.max().sort_index()
    assert counts.is_monotonic_increasing and counts.iloc[-1] == (t.n_features_observed >= 5).sum()


def _risk_labels(t):
    _labels(t)
    known = t[t.risk_label != "insufficient_data"]
    assert known.risk_score.notna().all() and known[known.risk_label == TIERS[0]].risk_score.mean() < 0.5 < known[known.risk_label == TIERS[2]].risk_score.mean()


def _scores(t):
    scored = t[t.signal_status == "scored"]
    assert len(scored) and scored.predicted_excess_return.notna().all() and scored.predicted_prob_positive.dropna().between(0, 1).all()
    assert (scored.training_window_n_rows >= 20).all() and (scored.n_features_observed >= 5).all()
    late = t.dropna(subset=["training_window_max_target_period_end"])
    assert (late.training_window_max_target_period_end <= late.rebal_date).all()


def _comparison(t, horizons=1):
    assert len(t) == 6 * horizons and set(t.framing) == {"regression", "classification"}
    assert t.auc.dropna().between(0, 1).all() and t.mean_ic.dropna().between(-1, 1).all() and t[t.framing == "classification"].mean_ic.isna().all()
    assert (t[t.framing == "regression"].n_pooled > 0).all()
    assert (t.n_folds_with_ic.dropna() <= t.n_folds[t.n_folds_with_ic.notna()]).all()


def _sweep(t):
    assert len(t) == 34 and t.silhouette.dropna().between(-1, 1).all() and t.noise_frac.between(0, 1).all()
    for tier, g in t[t.algorithm == "kmeans"].groupby("tier"):
        assert g.sort_values("k_or_mcs").cost.is_monotonic_decreasing and set(g.k_or_mcs) == set(range(2, 9)), tier
    soft = t[t.algorithm != "hdbscan"]
    assert (soft.n_clusters_found <= soft.k_or_mcs).all() and (soft.noise_frac == 0).all() and np.isfinite(soft.bic).all() and (soft.bic > soft.aic).all()


def _importance(t):
    assert abs(t.share_of_total.sum() - 1) < 1e-9 and (t.mean_abs_shap >= 0).all() and ((t.coef == 0) == (t.mean_abs_shap == 0)).all()


def _windows(t):
    ok = t[t.status == "ok"]
    assert t.rating_id.is_unique and ok["diff"].notna().all() and t[t.status != "ok"]["diff"].isna().all() and (ok.n_near_valid >= 2).all() and ok.near_mean.between(0, 1).all()


def _reasons(t):
    assert len(t) and set(t.reason) <= {"spike", "stuck", "impossible"} and not t.duplicated(["table_name", "field_name", "row_key"]).any()


VALUES = {
    "o130_linear_importance": _importance, "o137_density_labels": _labels, "o139_mixture_labels": _labels, "o139_risk_labels": _risk_labels,
    "o144_model_comparison": _comparison, "o145_scores": _scores, "o145_return_scores": _scores, "o146_horizon_comparison": lambda t: _comparison(t, 3), "o147_cluster_sweep": _sweep, "o089_risk_score_windows": _windows,
    "o039_satellite_panel": lambda t: (t.dm_em_flag == "EM").all(), "p5_reasons": _reasons, "p5_found": lambda t: not t.duplicated().any(),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_values_hold_together(spark, name):
    assert VALUES[name](QUERIES[name](spark, DATA).toPandas()) in (None, True)


def test_satellite_population(spark):
    panel = spark.createDataFrame([("A", "EM", 1, 0), ("A", "EM", 2, 0), ("B", "DM", 1, 0), ("C", "EM", 1, 0)], "country_code string, dm_em_flag string, rebal_date int, risk_label int")
    labels = spark.createDataFrame([("A", 1, TIERS[2]), ("A", 1, TIERS[2]), ("A", 2, TIERS[0]), ("B", 1, TIERS[2]), ("C", 1, "insufficient_data")], "country_code string, rebal_date int, risk_label string")
    assert [(r.country_code, r.rebal_date) for r in pipelines.satellite(panel, labels).collect()] == [("A", 1)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
