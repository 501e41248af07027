"""Logistic regression that goes on from known coefficients: Newton steps.

Each step is one pass over the rows: tasks add up loss, gradient and Hessian of their rows, the sums are
combined by place, and the driver solves a system of as many unknowns as there are features. Near
the optimum the error squares with every step, so coefficients of an earlier fit save most of them. A
step that would raise the loss is halved.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.operators.models import with_class_weights
from tableloom.staging import stage

MAX_FEATURES = 2000  # the Hessian has so many numbers squared


@dataclass(frozen=True)
class NewtonFit:
    coefficients: list[float]
    intercept: float
    steps: int
    loss: float
    converged: bool


def _pass(rows: DataFrame, beta: np.ndarray, intercept: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the weighted rows at ``beta`` (the intercept last)."""
    m = len(beta)
    upper = np.triu_indices(m)

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        loss, gradient, hessian = 0.0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if intercept:
                x = np.hstack([x, np.ones((len(x), 1))])
            y, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
            z = x @ beta
            p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
            loss += float(weight @ (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z))
            gradient += x.T @ (weight * (p - y))
            hessian += (x * (weight * p * (1 - p))[:, None]).T @ x
        values = np.concatenate([[loss], gradient, hessian[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    sums = rows.mapInArrow(partial, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros(1 + m + len(upper[0]))
    for row in sums.collect():
        total[row["place"]] = row["value"]
    hessian = np.zeros((m, m))
    hessian[upper] = total[1 + m :]
    return float(total[0]), total[1 : 1 + m], hessian + np.triu(hessian, 1).T


def newton_logistic(
    df: DataFrame,
    start: Sequence[float] | None = None,
    start_intercept: float = 0.0,
    penalty: str = "l2",
    C: float = 1.0,
    tol: float = 1e-8,
    max_iter: int = 50,
    fit_intercept: bool = True,
    class_weight: str | Mapping[Any, float] | None = None,
) -> NewtonFit:
    """Fit ``features`` and a two-class ``label`` (0 or 1), beginning at ``start`` or at zero.

    The loss is that of ``fit_logistic``: summed over the rows, with the penalty divided by
    ``C``. It ends when no coefficient would move by ``tol`` or more.
    """
    if penalty not in ("l2", "none"):
        raise ValueError(f"Newton steps need a smooth penalty, not {penalty!r}")
    weighted = with_class_weights(df, "label", class_weight)
    rows = stage(weighted.select(vector_to_array("features").alias("x"), "label", "weight"), "rows")
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("x")).alias("low"),
        F.max(F.size("x")).alias("high"),
        F.count_if(~F.col("label").isin(0.0, 1.0)).alias("other"),
    ).first()
    if not seen["n"]:
        raise ValueError("no rows to fit")
    if seen["other"]:
        raise ValueError("labels other than 0 and 1")
    size = seen["low"]
    if size != seen["high"] or size > MAX_FEATURES or (start is not None and len(start) != size):
        raise ValueError(f"rows of {size} to {seen['high']} features, a start of {None if start is None else len(start)}")
    beta = np.zeros(size) if start is None else np.array(start, float)
    if fit_intercept:
        beta = np.append(beta, start_intercept)
    ridge = np.full(len(beta), 0.0 if penalty == "none" else 1.0 / C)
    if fit_intercept:
        ridge[-1] = 0.0

    def at(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, hessian = _pass(rows, point, fit_intercept)
        return loss + float(ridge @ point**2) / 2, gradient + ridge * point, hessian + np.diag(ridge)

    loss, gradient, hessian = at(beta)
    steps, converged = 0, False
    while steps < max_iter:
        move = np.linalg.lstsq(hessian, -gradient, rcond=None)[0]
        if np.abs(move).max(initial=0.0) < tol:
            converged = True
            break
        steps += 1
        following = at(beta + move)
        while following[0] > loss + 1e-12 * abs(loss) and np.abs(move).max() >= tol:
            move = move / 2
            following = at(beta + move)
        beta = beta + move
        loss, gradient, hessian = following
    found = beta.tolist()
    return NewtonFit(found[:size], found[size] if fit_intercept else 0.0, steps, loss, converged)
