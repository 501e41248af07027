"""Logistic regression and classification metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Any

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.staging import new_path

METRICS = ("accuracy_score", "precision_score", "recall_score", "f1_score")
AVERAGES = ("binary", "micro", "macro", "weighted")
PENALTIES = ("l1", "l2", "elasticnet", "none")


def features_and_label(
    df: DataFrame, features: Sequence[str], label: str | None = None, invalid: str = "error"
) -> DataFrame:
    """``features`` as a vector and, for training, ``label`` as a double."""
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid=invalid
    )
    with_vector = assembler.transform(df)
    if label is None:
        return with_vector
    return with_vector.withColumn("label", F.col(label).cast("double"))


def with_class_weights(
    df: DataFrame, label: str, weights: str | Mapping[Any, float] | None, name: str = "weight"
) -> DataFrame:
    """Add the weight of each row: 1, a weight per class, or ``'balanced'``.

    A balanced weight is the number of rows over classes times rows of the class; the counts
    are joined, however many classes there are.
    """
    if weights == "balanced":
        counts = df.groupBy(F.col(label).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
        totals = counts.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k")).first()
        weight = F.lit(float(totals["n"] or 0)) / (F.lit(max(totals["k"], 1)) * F.col("__n"))
        return df.join(counts, F.col(label).eqNullSafe(F.col("__class"))).select(*df.columns, weight.alias(name))
    weight = F.lit(1.0)
    for value, factor in (weights or {}).items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(float(factor))).otherwise(weight)
    return df.withColumn(name, weight)


def fit_logistic(
    df: DataFrame,
    penalty: str = "l2",
    C: float = 1.0,
    l1_ratio: float | None = None,
    tol: float = 1e-4,
    max_iter: int = 100,
    fit_intercept: bool = True,
    class_weight: str | Mapping[Any, float] | None = None,
) -> LogisticRegressionModel:
    """Fit on ``features`` and ``label``.

    The loss is summed over the rows and weighed by ``C``, as is usual outside Spark; Spark
    averages it, so the penalty is divided by ``C`` times the total weight.
    """
    if penalty not in PENALTIES:
        raise ValueError(f"unknown penalty {penalty!r}")
    if penalty == "elasticnet" and l1_ratio is None:
        raise ValueError("elasticnet needs l1_ratio")
    weighted = with_class_weights(df, "label", class_weight)
    total = weighted.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("no rows to fit")
    mix = {"l1": 1.0, "l2": 0.0, "none": 0.0}.get(penalty, l1_ratio)
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        regParam=0.0 if penalty == "none" else 1.0 / (C * total),
        elasticNetParam=mix,
        standardization=False,
        tol=tol,
        maxIter=max_iter,
        fitIntercept=fit_intercept,
    ).fit(weighted)


def predict(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """Add prediction, class probabilities, their logarithms and the decision values."""
    scored = _without_summary(model, df).transform(df)
    probability = vector_to_array("probability")
    return scored.withColumns(
        {
            "probabilities": probability,
            "log_probabilities": F.transform(probability, lambda p: F.log(p)),
            "decisions": vector_to_array("rawPrediction"),
        }
    ).drop("probability", "rawPrediction")


def _without_summary(model: LogisticRegressionModel, df: DataFrame) -> LogisticRegressionModel:
    """A saved copy if the model is fresh from training.

    The training summary holds the session, and not every session can be sent to executors.
    """
    if not model.hasSummary:
        return model
    path = new_path(df.sparkSession, "model")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def attributes(model: LogisticRegressionModel) -> dict[str, Any]:
    """Classes, coefficients, intercepts and, right after fitting, the iterations."""
    return {
        "classes": list(range(model.numClasses)),
        "coefficients": model.coefficientMatrix.toArray().tolist(),
        "intercept": model.interceptVector.toArray().tolist(),
        "iterations": model.summary.totalIterations if model.hasSummary else None,
    }


def linear_score(coefficients: Mapping[str, float], intercept: float) -> dict[str, Column]:
    """Columns of a two-class model with known coefficients.

    Coefficients count as they are written: 0.15, not 0.15000000000000002, is 3 times 0.05, so rows on
    the border between the classes do not tip over by the product's error.
    """
    decision = F.lit(float(intercept))
    for column, factor in coefficients.items():
        decision = decision + _product(float(factor), F.col(column))
    probability = 1.0 / (1.0 + F.exp(-decision))
    return {
        "decision": decision,
        "probability": probability,
        "log_probability": -F.log1p(F.exp(-decision)),
        "prediction": (decision > 0).cast("int"),
    }


def _product(factor: float, column: Column) -> Column:
    """``factor * column`` as a double; with a whole-number column it is rounded once, from the exact product."""
    product = F.lit(factor) * column
    if not math.isfinite(factor):
        return product
    written = Decimal(repr(factor))
    _, digits, exponent = written.as_tuple()
    # Up to 17 digits, as 20 more of a bigint still fit a decimal of 38.
    if exponent > 0 or max(len(digits), -exponent) > 17:
        return product
    whole = F.typeof(column).isin("tinyint", "smallint", "int", "bigint")
    return F.when(whole, (F.lit(written) * column.cast("long")).cast("double")).otherwise(product)


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) for the pairs that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(
    df: DataFrame,
    label: str,
    prediction: str,
    metrics: Sequence[str] = METRICS,
    averages: Sequence[str] = ("binary",),
    positive: Any = 1,
) -> DataFrame:
    """(average, metric, value) from one count per (label, prediction), all in one pass.

    A class that is never predicted, or never occurs, scores 0.
    """
    for kind, given, known in (("metrics", metrics, METRICS), ("averages", averages, AVERAGES)):
        unknown = [g for g in given if g not in known]
        if unknown:
            raise ValueError(f"unknown {kind}: {unknown}")
    rows, none = F.col("n"), F.lit(0).cast("long")
    hits = F.when(F.col("label") == F.col("prediction"), rows).otherwise(none)
    # Each pair counts once for its true class and once for its predicted class.
    sides = F.array(
        F.struct(F.col("label").alias("class"), hits.alias("tp"), rows.alias("actual"), none.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), none.alias("tp"), none.alias("actual"), rows.alias("predicted")),
    )
    per_class = (
        confusion_matrix(df, label, prediction)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    )
    scores = {
        "precision_score": F.try_divide("tp", "predicted"),
        "recall_score": F.try_divide("tp", "actual"),
        # The harmonic mean of the two.
        "f1_score": F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("predicted")),
    }
    scored = per_class.select(
        "*", *[F.coalesce(value, F.lit(0.0)).alias(name) for name, value in scores.items()]
    )
    values = [
        _averaged(metric, average, positive).alias(f"{average}_{metric}")
        for average in averages
        for metric in metrics
    ]
    lines = [
        F.struct(
            F.lit(average).alias("average"),
            F.lit(metric).alias("metric"),
            F.col(f"{average}_{metric}").alias("value"),
        )
        for average in averages
        for metric in metrics
    ]
    return scored.agg(*values).select(F.inline(F.array(*lines)))


def _averaged(metric: str, average: str, positive: Any) -> Column:
    total = F.sum("actual")
    if metric == "accuracy_score" or average == "micro":
        # One label and one prediction per row make every micro average the accuracy.
        return F.sum("tp") / total
    if average == "macro":
        return F.avg(metric)
    if average == "weighted":
        return F.sum(F.col(metric) * F.col("actual")) / total
    return F.coalesce(F.max(F.when(F.col("class") == F.lit(positive), F.col(metric))), F.lit(0.0))
