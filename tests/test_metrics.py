import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import curves, evidence, explain, models, monitor, uncertainty


@pytest.fixture(scope="module")
def rare(spark):
    rows = [(0, 0.001)] * 994 + [(0, 0.9)] + [(1, p) for p in (0.99, 0.8, 0.7, 0.1, 0.05)]
    return spark.createDataFrame(rows, "label int, score double")


def test_metrics_at_low_prevalence(rare):
    r = curves.rates(curves.confusion(rare, 0.5)).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 1, 2, 994)
    assert (r["precision"], r["recall"]) == (0.75, 0.6)
    assert math.isclose(r["f1"], 2 / 3) and math.isclose(r["f2"], 15 / 24) and math.isclose(r["f05"], 3.75 / 5.25)
    empty = curves.rates(curves.confusion(rare.where("label = 2"), 0.5)).first()
    assert empty is None or empty["precision"] == 0


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_rank_metrics_with_ties(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 500), np.round(rng.random(500), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "label int, score double")
    r = curves.rank_metrics(df).first()
    assert math.isclose(r["roc_auc"], brute_auc(y, p), rel_tol=1e-12)
    ap, seen = 0.0, 0.0
    for t in sorted(set(p))[::-1]:
        recall = (y[p >= t] == 1).sum() / y.sum()
        ap, seen = ap + (recall - seen) * (y[p >= t] == 1).mean(), recall
    assert math.isclose(r["average_precision"], ap, rel_tol=1e-12)
    full = curves.partial_auc(df, (1.0,)).first()["partial_auc"]
    assert math.isclose(full, brute_auc(y, p), rel_tol=1e-9)
    assert curves.rank_metrics(df.where("label = 1")).first()["roc_auc"] is None


def test_thresholds_hold_their_limits(spark):
    rows = [(0, 0.99)] + [(0, 0.01)] * 999 + [(1, 0.5)] * 5
    df = spark.createDataFrame(rows, "label int, score double")
    best = {r["policy"]: r for r in curves.best_thresholds(curves.candidates(df), {"strict": ("recall", 0.0), "free": ("recall", None)}).collect()}
    assert best["strict"]["fp"] == 0 and best["strict"]["tp"] == 0 and 0.99 < best["strict"]["threshold"] < 0.99 + 1e-12
    assert best["free"]["tp"] == 5 and best["free"]["threshold"] == 0.5


def test_calibration_bins(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.5), (0, 0.5)], "label int, score double")
    t = curves.reliability(df, 4).orderBy("bin").collect()
    assert [r["n_rows"] for r in t] == [1, 0, 2, 1] and t[1]["observed"] is None
    assert curves.calibration(df, 4).first()["ece"] == 0 and curves.calibration(df, 4).first()["brier"] == 0.125


def test_drift_by_hand(spark):
    df = spark.createDataFrame([(i < 400, float(i)) for i in range(800)], "ref boolean, a double")
    r = monitor.drift(df, F.col("ref"), ("a",)).first()
    assert math.isclose(r["psi"], 16.578611218928522, rel_tol=1e-6) and math.isclose(r["js"], 0.5255965878951809, rel_tol=1e-6)
    flat = spark.createDataFrame([(i < 5, 1.0) for i in range(10)], "ref boolean, a double")
    assert monitor.drift(flat, F.col("ref"), ("a",)).first()["psi"] == 0


@pytest.mark.parametrize("q", [4, 5, 10])
def test_quantile_labels_are_those_of_unique_ranks(spark, q):
    import pandas as pd

    rng = np.random.default_rng(q)
    v = rng.integers(0, 30, 57).astype(float)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    got = [r["b"] for r in monitor.quantile_labels(df, "v", ("i",), q, "b").orderBy("i").collect()]
    assert got == (pd.qcut(pd.Series(v).rank(method="first"), q, labels=False) + 1).tolist()


def test_bootstrap_of_equal_groups(spark):
    rows = [(g, y, 0.9 if y else 0.01) for g in range(30) for y in (0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    r = {x["metric"]: x for x in uncertainty.confusion_interval(df, "g", 0.5, 100).collect()}
    assert (r["f2"]["point"], r["f2"]["lower_95"], r["f2"]["upper_95"]) == (1, 1, 1)
    d = uncertainty.paired_difference(df, df, "g", 0.5, 100).collect()
    assert all(x["point"] == x["lower_95"] == x["upper_95"] == 0 for x in d)


def test_draws_are_poisson(spark):
    w = spark.range(20000).select(uncertainty.weight(1, F.lit(0), F.col("id").cast("string")).alias("w"))
    m, v = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(m - 1) < 0.03 and abs(v - 1) < 0.06


def test_selections(spark):
    df = spark.createDataFrame([(i, i % 10 == 0, (i * 37 % 100) / 100) for i in range(1000)], "k int, y boolean, score double").withColumn("label", F.col("y").cast("int"))
    chosen = evidence.stratified(df, "k", ("label",), 100, "s")
    assert chosen.count() == 100 and chosen.where("label = 1").count() == 10
    h = evidence.handoff(df, "k", 0.5, 5, 40, "s")
    assert h.count() == 40 and h.where("outcome = 'TP'").count() >= 5
    e = evidence.hard_errors(df, "k", 0.5, 3, "s").collect()
    assert len(e) == 6 and all(len(r["sample_hash"]) == 64 for r in e)


def test_development_groups_are_whole_and_bounded(spark):
    g = spark.createDataFrame([(str(i), "ab"[i % 2], 4) for i in range(40)], "group_id string, stratum string, n_rows int")
    chosen = explain.development_groups(g, 80, "1")
    assert len(chosen) == 20 and sum(int(c) % 2 for c in chosen) == 10


def test_explanations_find_the_signal(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(a + 0.25 * rng.standard_normal() > 0)) for i, (a, b) in enumerate(rng.standard_normal((400, 2)))]
    df = spark.createDataFrame(rows, "k int, signal double, noise double, label int")
    m = models.fit(models.prepared(df, ("signal", "noise")), ("signal", "noise"), models.candidates(2)["logistic_1.0"])
    score = models.expression(m, ("signal", "noise"))
    same = models.scored(m, models.prepared(df, ("signal", "noise"))).withColumn("again", score(explain.given(("signal", "noise"))))
    assert same.where("abs(score - again) > 1e-9").count() == 0
    p = {r["feature"]: r["importance"] for r in explain.permutation_importance(df, score, ("signal", "noise"), "k").collect()}
    assert p["signal"] > 0.05 > abs(p["noise"])
    a = explain.attributions(df, score, ("signal", "noise"), "k").groupBy("feature").agg(F.avg(F.abs("attribution")).alias("x"))
    assert {r["feature"]: r["x"] > 0.05 for r in a.collect()} == {"signal": True, "noise": False}
    assert explain.faithfulness(df, score, models.importances(m, ("signal", "noise")), ("signal", "noise"), 1).first()["passed"]
    e = explain.effects(df, score, "signal", ("signal", "noise")).orderBy("bin").collect()
    assert e[0]["effect"] < 0 < e[-1]["effect"]
    control = models.negative_control(df, ("signal", "noise"), "k").first()["roc_auc"]
    assert 0.3 < control < 0.7


def test_models_and_calibration(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), int(rng.random() < 1 / (1 + math.exp(-3 * a)))) for i, a in enumerate(rng.standard_normal(600))]
    df = spark.createDataFrame(rows, "k int, x double, label int")
    results = models.cross_validate(df, ("x",), "k", ("logistic_1.0", "forest"), 2)
    assert models.choose(results).first()["mean_auc"] > 0.75
    ready = models.prepared(df, ("x",))
    members = [models.fit(ready, ("x",), models.candidates(1)[n]) for n in ("logistic_0.1", "logistic_1.0")]
    s = models.ensemble(members, ready).select("label", "score")
    assert s.where("score is null").count() == 0
    assert models.best_calibrator(models.calibrators(s)) in ("identity", "platt", "isotonic")
    split = models.role_split(df, "k", "label").groupBy("role").count().collect()
    assert {r["role"] for r in split} == {"train", "validation", "calibration", "test"}


def test_registered_bootstraps_draw_as_many_as_the_configuration(spark, monkeypatch):
    import inspect

    from lumenfold.operators import uncertainty
    from lumenfold.plans import catalogue

    drawn = []
    interval = spark.createDataFrame([("f1", 0.0, 0.0, 0.0)], "metric string, point double, lower_95 double, upper_95 double")
    for name in ("confusion_interval", "ranking_interval", "paired_difference"):
        kind = inspect.signature(getattr(uncertainty, name))

        def record(*args, kind=kind, **named):
            given = kind.bind(*args, **named)
            given.apply_defaults()
            drawn.append(given.arguments["replicates"])
            return interval

        monkeypatch.setattr(uncertainty, name, record)
    monkeypatch.setattr(catalogue, "scores", lambda s, d: s.createDataFrame([(0.5,)], "score double"))
    import __spark_entry__

    for name in ("bootstrap_ci", "ranking_ci", "paired_difference"):
        __spark_entry__.queries()[name](spark, "")
    assert drawn == [1000, 200, 1000]
