"""Trends from tables of days.

A row of the state adds one to the day it was introduced and one to the day it
was resolved. What a batch changes is the same sums after it less those before
it, over the rows it touched; such changes only ever add up. So a trend reads a
row for each repository, day, severity and category in which anything changed,
and no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values.enums import SEVERITIES
from ..sources.tables import Store
from .dashboard import StatsFilter, balance, day_spine

DAYS = "repository_id long, date date, severity string, category string, introduced long, resolved long"
_KEY = ["repository_id", "date", "severity", "category"]


def _signed(state: DataFrame, sign: int) -> DataFrame:
    one, none = F.lit(sign).cast("long"), F.lit(0).cast("long")

    def event(at: str, introduced: Column, resolved: Column) -> Column:
        return F.when(
            F.col(at).isNotNull(),
            F.struct(F.to_date(at).alias("date"), introduced.alias("introduced"), resolved.alias("resolved")),
        )

    events = F.array_compact(F.array(event("first_seen_at", one, none), event("resolved_at", none, one)))
    return state.select("repository_id", "severity", "category", F.inline(events))


def merged(days: DataFrame) -> DataFrame:
    """Changes added up; what has cancelled out is gone."""
    sums = days.groupBy(*_KEY).agg(F.sum("introduced").alias("introduced"), F.sum("resolved").alias("resolved"))
    return sums.where("introduced <> 0 or resolved <> 0").select(*_KEY, "introduced", "resolved")


def day_changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """What days gain and lose when state rows `before` become `after`; rows that are in both cancel out."""
    changed = _signed(after, 1)
    return merged(changed if before is None else changed.unionByName(_signed(before, -1)))


def _of(days: DataFrame, repositories: DataFrame, flt: StatsFilter) -> DataFrame:
    repos = repositories.select(F.col("id").alias("repository_id"), "full_name")
    if flt.repository is not None:
        repos = repos.where(F.col("full_name") == flt.repository)
    return days.join(repos.select("repository_id"), "repository_id")


def trend(days: DataFrame, store: Store, flt: StatsFilter, by_severity: bool = False) -> DataFrame:
    """`dashboard.trend` from a table of days. What came before the window is its balance then."""
    early = F.col("date") < F.lit(flt.first_day)
    known = F.col("severity").isin(*SEVERITIES)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    introduced, resolved = F.col("introduced"), F.col("resolved")
    per_day = (
        _of(days, store.repositories, flt)
        .groupBy(F.when(early, F.lit(flt.first_day)).otherwise(F.col("date")).alias("date"))
        .agg(
            total(F.when(~early & known, introduced)).alias("introduced"),
            total(F.when(~early, resolved)).alias("resolved"),
            total(F.when(early, introduced - resolved)).alias("carried"),
            *[total(F.when(~early & (F.col("severity") == s), introduced)).alias(s) for s in SEVERITIES],
        )
    )
    return balance(per_day, store, flt, by_severity)


def category_trend(days: DataFrame, store: Store, flt: StatsFilter) -> DataFrame:
    """`dashboard.category_trend` from a table of days."""
    names = {c: c.lower().replace("-", "_") for c in store.categories}
    counts = _of(days, store.repositories, flt).where(F.col("date") >= F.lit(flt.first_day)).groupBy("date").agg(
        *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("introduced"))), F.lit(0)).cast("long").alias(name) for c, name in names.items()]
    )
    return day_spine(store, flt).join(counts, "date", "left").na.fill(0, list(names.values()))
