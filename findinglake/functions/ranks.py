"""Ordinal columns for the text enums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values.enums import CONFIDENCES, SEVERITIES


def choose(branches: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """One flat CASE: the first branch that holds decides."""
    (condition, value), *rest = branches
    expr = F.when(condition, value)
    for condition, value in rest:
        expr = expr.when(condition, value)
    return expr.otherwise(otherwise)


def ordinal(value: Column, order: Sequence[str], otherwise: int | None = None) -> Column:
    return choose([(value == F.lit(name), F.lit(rank)) for rank, name in enumerate(order)], F.lit(otherwise).cast("int"))


def severity_rank(value: Column) -> Column:
    """critical 0 … info 4; unknown text ranks with info."""
    return ordinal(value, SEVERITIES, len(SEVERITIES) - 1)


def confidence_rank(value: Column) -> Column:
    """high 0, medium 1, low 2."""
    return ordinal(value, CONFIDENCES, len(CONFIDENCES) - 1)


def severity_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank)


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """A literal map probe; null for a missing key."""
    return choose([(key == F.lit(k), F.lit(v)) for k, v in mapping.items()], F.lit(None).cast("string"))


def severity_at_least(value: Column, floor: str) -> Column:
    """True where the severity is the floor or worse."""
    return severity_rank(value) <= F.lit(SEVERITIES.index(floor))
