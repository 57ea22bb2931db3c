"""PSI / KS against numpy histograms and distribution functions; retraining rules on a
hand-built signals table (R1–R7)."""

import random

import numpy as np

from pyspark.sql import functions as F

from tessera.operators import drift as D


def histogram_psi(b, c, bins=10):
    edges = np.linspace(min(*b, *c), max(*b, *c), bins + 1)
    p, q = (np.histogram(x, edges)[0] / len(x) + 1e-6 for x in (b, c))
    return float(((q - p) * np.log(q / p)).sum())


def cdf_gap(b, c):
    at = np.concatenate([b, c])
    return float(np.abs(np.searchsorted(np.sort(b), at, "right") / len(b) - np.searchsorted(np.sort(c), at, "right") / len(c)).max())


def test_psi_and_ks_match_python(spark):
    rnd = random.Random(7)
    b = [round(rnd.gauss(0, 1), 2) for _ in range(400)]
    c = [round(rnd.gauss(0.4, 1.2), 2) for _ in range(300)]
    bd = spark.createDataFrame([(x,) for x in b], "x double")
    cd = spark.createDataFrame([(x,) for x in c], "x double")
    got = D.psi(bd, cd, ["x"]).first()["psi"]
    assert abs(got - histogram_psi(b, c)) < 1e-8
    ks = D.ks_two_sample(bd, cd, "x").first()["ks"]
    assert abs(ks - cdf_gap(b, c)) < 1e-8


def test_psi_constant_is_zero(spark):
    d = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert D.psi(d, d, ["x"]).first()["psi"] == 0.0


def test_retrain_rules(spark):
    rows = [
        # name, baseline, decay, drift, days, new
        ("critical_low_volume", 1.0, 0.30, False, 3, 50),
        ("drift_old", 1.0, 0.0, True, 9, 20000),
        ("drift_recent", 1.0, 0.0, True, 3, 20000),
        ("stale", 1.0, 0.0, False, 20, 20000),
        ("stale_low_volume", 1.0, 0.0, False, 20, 10),
        ("quiet", 1.0, 0.0, False, 2, 20000),
    ]
    df = spark.createDataFrame(
        [(n, b, d, dr, [] if not dr else ["drift reason"], days, new) for n, b, d, dr, days, new in rows],
        "name string, metric_baseline double, relative_decay double, needs_retraining boolean, "
        "reasons array<string>, days_since_training int, new_interactions long")
    got = {r["name"]: r for r in D.retrain_decision(df).collect()}
    assert got["critical_low_volume"]["priority"] == "critical"
    assert got["critical_low_volume"]["should_retrain"] is False
    assert got["critical_low_volume"]["blocked_by_volume"] is True
    assert (got["drift_old"]["priority"], got["drift_old"]["should_retrain"]) == ("high", True)
    assert got["drift_recent"]["priority"] == "normal"
    assert got["stale"]["priority"] == "normal" and got["stale"]["should_retrain"]
    assert got["stale_low_volume"]["priority"] == "skip"
    assert got["quiet"]["priority"] == "skip" and not got["quiet"]["should_retrain"]
    cfg = {r["name"]: r for r in D.retrain_config(D.retrain_decision(df)).collect()}
    assert cfg["critical_low_volume"]["epochs"] == 15 and cfg["drift_old"]["epochs"] == 10
    assert cfg["quiet"]["batch_size"] == 256
    short = {r["name"]: r["decision"] for r in D.retrain_short(df).collect()}
    assert short["drift_recent"] == "trigger_immediate_retrain"
    assert short["stale"] == "trigger_scheduled_retrain" and short["quiet"] == "no_retrain_needed"


def test_metric_decay(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "b double, c double")
    got = [r[0] for r in df.select(D.metric_decay(F.col("b"), F.col("c"))).collect()]
    assert got == [0.0, 0.5]


def test_weighted_baseline_equals_raw(spark):
    rnd = random.Random(11)
    b = [round(rnd.choice([0.5, 1.25, 2.0, 3.75]), 2) for _ in range(300)]
    c = [round(rnd.gauss(2, 1), 1) for _ in range(200)]
    bd = spark.createDataFrame([(x,) for x in b], "x double")
    cd = spark.createDataFrame([(x,) for x in c], "x double")
    agg = bd.groupBy("x").count()
    assert D.psi(agg, cd, ["x"], base_weight="count").first()["psi"] == D.psi(bd, cd, ["x"]).first()["psi"]
    assert (D.ks_two_sample(agg, cd, "x", base_weight="count").first()["ks"]
            == D.ks_two_sample(bd, cd, "x").first()["ks"])
