"""Chained steps with named inputs, defaults, required inputs and run-time variables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

REQUIRED = object()


@dataclass(frozen=True)
class Variable:
    """A value given when the steps run."""

    name: str


@dataclass(frozen=True)
class Step:
    """A function from frame to frame. ``inputs`` maps input names to defaults."""

    run: Callable[..., DataFrame]
    inputs: Mapping[str, Any] = field(default_factory=dict)

    def resolve(self, variables: Mapping[str, Any]) -> dict[str, Any]:
        resolved = {}
        for name, value in self.inputs.items():
            if isinstance(value, Variable):
                if value.name not in variables:
                    raise ValueError(f"variable {value.name!r} is not set")
                value = variables[value.name]
            if value is REQUIRED:
                raise ValueError(f"input {name!r} is required")
            resolved[name] = value
        return resolved

    def with_inputs(self, **inputs: Any) -> "Step":
        unknown = set(inputs) - set(self.inputs)
        if unknown:
            raise ValueError(f"unknown inputs: {sorted(unknown)}")
        return Step(self.run, {**self.inputs, **inputs})


def run_steps(
    df: DataFrame, steps: Sequence[Step], variables: Mapping[str, Any] | None = None
) -> DataFrame:
    """Apply the steps in turn; inputs are checked before the first one runs."""
    resolved = [step.resolve(variables or {}) for step in steps]
    for step, inputs in zip(steps, resolved):
        df = df.transform(lambda frame, s=step, i=inputs: s.run(frame, **i))
    return df


def row_function(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply a Python function to Arrow batches of rows, for what no expression can say."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield function(frame)

    return df.mapInPandas(batches, schema)
