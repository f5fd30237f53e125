"""Evaluators as plug-ins: a function that names columns for a frame, or for
the frames of a candidate, in place of a callback that is called for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

#: What any evaluator must name.
RESULT = ("score", "accepted")
Evaluator = Callable[[], dict[str, Column]]


def _named(evaluator: Evaluator, rows: DataFrame) -> list[Column]:
    got = evaluator()
    missing = [c for c in RESULT if c not in got]
    if missing:
        raise ValueError(f"an evaluator must name {missing}")
    if taken := [c for c in got if c in rows.columns]:
        raise ValueError(f"an evaluator may not replace {taken}")
    return [column.alias(name) for name, column in got.items()]


def evaluate(rows: DataFrame, evaluator: Evaluator) -> DataFrame:
    """Each row with what the evaluator says of it."""
    return rows.select("*", *_named(evaluator, rows))


def evaluate_groups(rows: DataFrame, keys: list[str], evaluator: Evaluator) -> DataFrame:
    """Each group with what the evaluator, by aggregates, says of its rows."""
    return rows.groupBy(*keys).agg(*_named(evaluator, rows))
