"""Exact median age without sorting the column in one task."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_median(df: DataFrame, column: str, as_of: datetime, weight: Column) -> DataFrame:
    """One row, one column: median of (as_of - column) in days, one decimal.

    A row counts `weight` times; null is not at all.

    Narrow in steps: equal timestamps collapse to counts, the counts add up to
    a per-day histogram, and only the day or two that hold the middle ranks are
    opened. The global window sees one row per day; the inner one sees one row
    per distinct timestamp of a day.
    """
    at = F.col(column)
    ticks = df.groupBy(F.to_date(at).alias("d"), at.alias("t")).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n"))
    days = ticks.groupBy("d").agg(F.sum("n").alias("n"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = days.select(
        "d",
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
        F.sum("n").over(whole).alias("total"),
    )
    # 1-based ranks of the two middle rows (the same rank twice for an odd count).
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    middle = (
        ranked.select("d", "n", "below", low.alias("lo"), high.alias("hi"))
        .where((F.col("lo") > F.col("below")) & (F.col("lo") <= F.col("below") + F.col("n"))
               | (F.col("hi") > F.col("below")) & (F.col("hi") <= F.col("below") + F.col("n")))
        .select("d", "below", "lo", "hi")
    )
    within = Window.partitionBy("d").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ticks.join(middle, "d").select(
        "t", "n", "lo", "hi", (F.col("below") + F.sum("n").over(within)).alias("upto")
    )
    start = F.col("upto") - F.col("n")

    def age_at(rank: str):
        hit = (F.col(rank) > start) & (F.col(rank) <= F.col("upto"))
        # unix seconds via a constant epoch keep the arithmetic in integers
        return F.max(F.when(hit, F.timestamp_diff("SECOND", F.col("t"), F.lit(as_of).cast("timestamp_ntz"))))

    return placed.agg(F.round((age_at("lo") + age_at("hi")) / 2 / 86400.0, 1).alias("median"))
