"""Train and score a logistic regression with its encoders saved alongside."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.operators.columns import drop_nulls
from tableloom.operators.models import fit_logistic, predict
from tableloom.operators.newton import NewtonFit, newton_logistic


def string_indexer(
    df: DataFrame, columns: Sequence[str], order: str, suffix: str = "_idx"
) -> StringIndexerModel:
    """Index text columns; unknown values get a number of their own.

    A model of this kind holds its labels, so they come to the driver. For columns with very
    many values use ``category_codes``, which keeps them in a table.
    """
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[c + suffix for c in columns],
        stringOrderType=order,
        handleInvalid="keep",
    ).fit(df)


@dataclass(frozen=True)
class TrainingPlan:
    features: Sequence[str]
    label: str
    categories: Sequence[str] = field(default_factory=tuple)
    not_null: Sequence[str] = field(default_factory=tuple)
    model: dict[str, Any] = field(default_factory=dict)


def train_counted(df: DataFrame, plan: TrainingPlan) -> tuple[PipelineModel, int]:
    """Fit on the complete rows; also how many rows were left out for a NULL.

    Codes of categories are 0-based in sorted order, -1 for unknown. The model itself keeps
    every row it is given.
    """
    rows = drop_nulls(df, plan.not_null)
    stages: list[Any] = []
    if plan.categories:
        indexer = string_indexer(rows, plan.categories, "alphabetAsc")
        unknown = [len(labels) for labels in indexer.labelsArray]
        codes = ", ".join(
            f"IF(`{c}_idx` = {n}, -1.0D, `{c}_idx`) AS `{c}_code`"
            for c, n in zip(plan.categories, unknown)
        )
        stages += [indexer, SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__")]
    columns = [f"{c}_code" if c in plan.categories else c for c in plan.features]
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    encoded = PipelineModel([*stages, assembler]).transform(rows).where(_complete(columns) & F.col(plan.label).isNotNull())
    # The fit reads its rows many times anyway, so a count is cheap.
    left_out = df.count() - encoded.count()
    model = fit_logistic(
        encoded.select("features", F.col(plan.label).cast("double").alias("label")), **plan.model
    )
    return PipelineModel([*stages, assembler, model]), left_out


def train(df: DataFrame, plan: TrainingPlan) -> PipelineModel:
    """Drop incomplete rows, encode categories, fit."""
    return train_counted(df, plan)[0]


def refit(model: PipelineModel, df: DataFrame, plan: TrainingPlan) -> tuple[PipelineModel, NewtonFit]:
    """Fit a saved model again on other rows, from its coefficients on, with its own category codes.

    ``plan.model`` takes penalty (l2 or none), C, tol, max_iter, fit_intercept and class_weight. A category
    that the model does not know has the code -1.
    """
    rows = drop_nulls(df, plan.not_null)
    encoded = PipelineModel(model.stages[:-1]).transform(rows)
    (assembler,) = [s for s in model.stages if isinstance(s, VectorAssembler)]
    complete = encoded.where(_complete(assembler.getInputCols()) & F.col(plan.label).isNotNull())
    last: LogisticRegressionModel = model.stages[-1]
    if last.numClasses != 2:
        raise ValueError(f"a model of {last.numClasses} classes")
    fit = newton_logistic(
        complete.select("features", F.col(plan.label).cast("double").alias("label")),
        last.coefficients.toArray().tolist(),
        last.intercept,
        **plan.model,
    )
    return PipelineModel([*model.stages[:-1], with_coefficients(last, fit)]), fit


def with_coefficients(model: LogisticRegressionModel, fit: NewtonFit) -> LogisticRegressionModel:
    """A two-class model with the columns and parameters of ``model`` and other coefficients."""
    context = SparkSession.active().sparkContext
    kind = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    fresh = kind(model.uid, _py2java(context, Vectors.dense(fit.coefficients)), fit.intercept)
    return LogisticRegressionModel(model._java_obj.copyValues(fresh, model._java_obj.extractParamMap()))


def _complete(columns: Sequence[str]) -> Column:
    complete = F.lit(True)
    for column in columns:
        value = F.col(f"`{column}`")
        complete = complete & value.isNotNull() & ~F.isnan(value.cast("double"))
    return complete


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every row, with prediction, probabilities, log probabilities and decision values.

    They are NULL where a feature is.
    """
    encoded = PipelineModel(model.stages[:-1]).transform(df)
    helpers = ["features"] + [c for c in encoded.columns if c not in df.columns]
    (assembler,) = [s for s in model.stages if isinstance(s, VectorAssembler)]
    predicted = predict(model.stages[-1], encoded.withColumn("__complete", _complete(assembler.getInputCols())))
    found = [c for c in predicted.columns if c not in encoded.columns and c != "__complete"]
    known = {c: F.when(F.col("__complete"), F.col(c)) for c in found}
    return predicted.withColumns(known).drop(*helpers, "__complete")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
