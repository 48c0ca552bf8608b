"""Collects the registered queries of every catalogue module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code, dashboards, growth, inputs, lifecycles, reviews, texts

_MODULES = (dashboards, lifecycles, reviews, texts, inputs, code, growth)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
