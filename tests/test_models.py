import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.operators import encode, models, newton
from tableloom.plans import training
from tableloom.staging import new_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_capped_categories(spark):
    values = ["a"] * 5 + ["b"] * 4 + [None] * 3 + ["c", "d"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    top = encode.fit_categories(df, "x", 3)
    assert top.labels == ("a", "b", None) and top.has_other
    assert top.slots() == ["x_a", "x_b", "x_None", "x_OTHER"]
    found = dict(rows(df.select("x", top.index().alias("i")).distinct()))
    assert found == {"a": 0, "b": 1, None: 2, "c": 3, "d": 3}
    hot = {tuple(r)[0]: tuple(r)[1:] for r in df.select("x", *top.one_hot()).distinct().collect()}
    assert hot == {"a": (1, 0, 0, 0), "b": (0, 1, 0, 0), None: (0, 0, 1, 0), "c": (0, 0, 0, 1), "d": (0, 0, 0, 1)}


def test_unseen_value_without_other(spark):
    fitted = encode.fit_categories(spark.createDataFrame([("a",), ("b",)], "x string"), "x", 5)
    assert fitted.labels == ("a", "b") and not fitted.has_other
    new = spark.createDataFrame([("z",), (None,), ("b",)], "x string")
    assert rows(new.select("x", fitted.index().alias("i"), *fitted.one_hot())) == [
        ("b", 1, 0, 1), ("z", 2, 0, 0), (None, 2, 0, 0)]
    with pytest.raises(ValueError):
        encode.fit_categories(new, "x", 0)


@pytest.mark.parametrize("local_labels", [1, 100])
def test_category_codes(spark, local_labels):
    df = spark.createDataFrame([("m",), ("b",), (None,), ("b",), ("z",)], "x string")
    got = encode.category_codes(df, ["x"], local_labels=local_labels)
    assert rows(got) == [("b", 0), ("b", 0), ("m", 1), ("z", 2), (None, -1)]


@pytest.fixture(scope="module")
def sample(spark):
    random = np.random.default_rng(4)
    x = random.normal(size=(400, 2))
    y = (x @ np.array([1.2, -0.7]) + 0.3 + random.logistic(size=400) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    return x, y, models.features_and_label(df, ["a", "b"], "y").select("features", "label")


@pytest.mark.parametrize("C", [0.1, 1.0, 10.0])
@pytest.mark.parametrize("class_weight", [None, "balanced", {0.0: 2.0, 1.0: 0.5}])
def test_fit_is_the_optimum_of_the_summed_loss(sample, C, class_weight):
    x, y, df = sample
    model = models.fit_logistic(df, C=C, tol=1e-9, class_weight=class_weight)
    w, b = np.array(model.coefficients), model.intercept
    if class_weight == "balanced":
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    elif class_weight:
        weight = np.where(y == 1, class_weight[1.0], class_weight[0.0])
    else:
        weight = np.ones_like(y)
    error = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(C * (x.T @ error) + w).max() < 1e-2 * C
    assert abs(error.sum()) < 1e-2


def test_penalties(sample):
    _, _, df = sample
    free = models.fit_logistic(df, penalty="none")
    l1 = models.fit_logistic(df, penalty="l1", C=0.005)
    mixed = models.fit_logistic(df, penalty="elasticnet", C=0.01, l1_ratio=0.5)
    size = lambda m: float(np.abs(np.array(m.coefficients)).sum())
    assert size(l1) < size(mixed) < size(free)
    for bad in ({"penalty": "l3"}, {"penalty": "elasticnet"}):
        with pytest.raises(ValueError):
            models.fit_logistic(df, **bad)


def test_predictions_and_attributes(sample):
    _, _, df = sample
    model = models.fit_logistic(df)
    found = models.attributes(model)
    assert found["classes"] == [0, 1] and len(found["coefficients"][0]) == 2 and found["iterations"] > 0
    r = models.predict(model, df).first()
    assert math.isclose(sum(r.probabilities), 1)
    assert math.isclose(r.log_probabilities[1], math.log(r.probabilities[1]))
    assert math.isclose(r.probabilities[1], 1 / (1 + math.exp(-r.decisions[1])))
    assert r.prediction == float(r.decisions[1] > 0)


def test_metrics_by_hand(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] * 1 + [(2, 0)] * 1
    df = spark.createDataFrame(pairs, "y int, p int")
    got = {(a, m): v for a, m, v in rows(models.classification_metrics(df, "y", "p", averages=models.AVERAGES))}
    assert math.isclose(got["binary", "accuracy_score"], 8 / 12)
    assert math.isclose(got["binary", "precision_score"], 3 / 5)
    assert math.isclose(got["binary", "recall_score"], 3 / 4)
    assert math.isclose(got["binary", "f1_score"], 2 * 3 / (4 + 5))
    assert math.isclose(got["micro", "f1_score"], 8 / 12)
    assert math.isclose(got["macro", "precision_score"], (5 / 7 + 3 / 5 + 0) / 3)
    assert math.isclose(got["weighted", "recall_score"], (5 / 7 * 7 + 3 / 4 * 4 + 0) / 12)
    for bad in ({"metrics": ["roc_curve"]}, {"averages": ["samples"]}):
        with pytest.raises(ValueError):
            models.classification_metrics(df, "y", "p", **bad)


def test_train_save_load_score(spark):
    data = [(float(i % 7), "ab"[i % 2], (i % 7 > 3) == (i % 2 == 0), None if i % 10 == 9 else "x") for i in range(200)]
    df = spark.createDataFrame([(a, c, int(y), n) for a, c, y, n in data], "a double, c string, y int, n string")
    plan = training.TrainingPlan(["a", "c"], "y", categories=["c"], not_null=["n"], model={"C": 10.0})
    model = training.train(df, plan)
    path = new_path(spark, "model")
    training.save(model, path)
    new = spark.createDataFrame([(1.0, "a"), (2.0, "unseen"), (3.0, None)], "a double, c string")
    before, after = training.score(model, new), training.score(training.load(path), new)
    assert rows(before) == rows(after) and before.count() == 3
    assert before.columns[:3] == ["a", "c", "prediction"]
    # Codes follow sorted order, unknown and NULL are -1.
    codes = training.PipelineModel(model.stages[:2]).transform(new).select("c", "c_code")
    assert rows(codes) == [("a", 0.0), ("unseen", -1.0), (None, -1.0)]


def test_rows_without_a_feature_are_scored_without_a_prediction(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1), (None, 1), (5.0, None)], "a double, y int")
    model, left_out = training.train_counted(df, training.TrainingPlan(["a"], "y"))
    assert left_out == 2
    scored = {r.a: r.prediction for r in training.score(model, df.select("a")).collect()}
    assert len(scored) == 6 and scored[None] is None and scored[1.0] is not None


@pytest.mark.parametrize("listed", [0, 50])
def test_names_of_slots_do_not_clash(spark, monkeypatch, listed):
    monkeypatch.setattr(encode, "LISTED", listed)
    values = ["OTHER"] * 5 + ["a"] * 4 + [None] * 3 + ["None"] * 2 + ["z"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    top = encode.fit_categories(df, "x", 4)
    assert len({s.lower() for s in top.slots()}) == 5 and top.slots()[-1] == "x_OTHER_1"
    counts = dict(rows(df.groupBy(top.capped().alias("c")).count()))
    assert counts == {"OTHER": 5, "a": 4, None: 3, "None": 2, "OTHER_1": 1}
    hot = {r[0]: tuple(r)[1:] for r in top.with_one_hot(df, ["x"]).collect()}
    assert hot["OTHER"] == (1, 0, 0, 0, 0) and hot["z"] == (0, 0, 0, 0, 1) and sum(hot[None]) == sum(hot["None"]) == 1


@pytest.mark.parametrize("penalty", ["l2", "none"])
@pytest.mark.parametrize("class_weight", [None, "balanced"])
def test_newton_steps_reach_the_same_optimum(sample, penalty, class_weight):
    _, _, df = sample
    wanted = models.fit_logistic(df, penalty, C=0.5, tol=1e-10, class_weight=class_weight)
    cold = newton.newton_logistic(df, penalty=penalty, C=0.5, class_weight=class_weight)
    assert cold.converged and np.allclose(cold.coefficients, wanted.coefficients, atol=1e-5)
    assert math.isclose(cold.intercept, wanted.intercept, abs_tol=1e-5)
    # From near the optimum there is less to do, and from the optimum nothing.
    near = [c + 0.01 for c in cold.coefficients]
    warm = newton.newton_logistic(df, near, cold.intercept, penalty, 0.5, class_weight=class_weight)
    again = newton.newton_logistic(df, cold.coefficients, cold.intercept, penalty, 0.5, class_weight=class_weight)
    assert np.allclose(warm.coefficients, cold.coefficients, atol=1e-6)
    assert again.steps == 0 < warm.steps < cold.steps


def test_newton_edges(spark, sample):
    _, _, df = sample
    flat = newton.newton_logistic(df, fit_intercept=False, C=0.5)
    wanted = models.fit_logistic(df, C=0.5, tol=1e-10, fit_intercept=False)
    assert flat.intercept == 0.0 and np.allclose(flat.coefficients, wanted.coefficients, atol=1e-5)
    far = newton.newton_logistic(df, [40.0, 40.0], -30.0)  # whole steps would overshoot
    assert far.converged and np.allclose(far.coefficients, newton.newton_logistic(df).coefficients, atol=1e-6)
    for bad in (df.limit(0), df.withColumn("label", F.lit(2.0))):
        with pytest.raises(ValueError):
            newton.newton_logistic(bad)
    with pytest.raises(ValueError):
        newton.newton_logistic(df, [1.0])
    with pytest.raises(ValueError):
        newton.newton_logistic(df, penalty="l1")


def test_a_saved_model_is_fitted_on(spark):
    rng = np.random.default_rng(3)
    data = [(c, float(x), int(rng.random() < 1 / (1 + np.exp(-(x + (c == "b")))))) for c, x in zip(rng.choice(list("ab"), 300), rng.normal(size=300))]
    data = [(str(c), x, y) for c, x, y in data]
    old = spark.createDataFrame(data[:150], "c string, x double, y int")
    new = spark.createDataFrame(data + [(None, 1.0, 1), ("a", None, 0)], "c string, x double, y int")
    plan = training.TrainingPlan(["c", "x"], "y", ["c"], ["c"], {"C": 2.0})
    path = new_path(spark, "model")
    training.save(training.train(old, plan), path)
    model, fit = training.refit(training.load(path), new, plan)
    whole = training.train(new, training.TrainingPlan(["c", "x"], "y", ["c"], ["c"], {"C": 2.0, "tol": 1e-10})).stages[-1]
    assert np.allclose(model.stages[-1].coefficients, whole.coefficients, atol=1e-5)
    assert math.isclose(model.stages[-1].intercept, whole.intercept, abs_tol=1e-5)
    again = new_path(spark, "model")
    training.save(model, again)
    assert training.score(training.load(again), new).count() == 302 and fit.converged


def test_scores_on_the_border(spark):
    border = [(750.0, 24), (875.0, 23), (1375.0, 19), (1625.0, 17), (2000.0, 14), (2250.0, 12)]  # -1.5 + 0.0004 a + 0.05 n = 0
    near = [(a + step, n) for a, n in border for step in (-0.01, 0.01)]
    df = spark.createDataFrame([*border, *near, (None, 3), (3.0, None)], "a double, n int")
    scores = models.linear_score({"a": 0.0004, "n": 0.05}, -1.5)
    found = {(r.a, r.n): (r.d, r.p) for r in df.select("a", "n", scores["decision"].alias("d"), scores["prediction"].alias("p")).collect()}
    assert [found[b] for b in border] == [(0.0, 0)] * len(border)
    assert [found[b][1] for b in near] == [0, 1] * len(border)
    assert found[None, 3] == found[3.0, None] == (None, None)
    # Long coefficients, odd types and the widest numbers go as they did, or exactly.
    wide = spark.createDataFrame([(2**63 - 1, 0.25, "2")], "n long, x float, s string")
    for factor in (1e-30, 1.2345678901234567e-5, 0.5, 1e16, 1e22, -3.0, float("inf")):
        for column, value in (("n", 2.0**63), ("x", 0.25), ("s", 2.0)):
            assert wide.select(models.linear_score({column: factor}, 0.0)["decision"]).first()[0] == pytest.approx(factor * value, rel=1e-15)
