"""Closing a bounded number of the oldest open findings each day.

Day after day, up to a quota of the open findings that were first seen by then
are resolved, the oldest first. Nothing loops over days. With A the findings
seen up to a day and Q the sum of quotas up to it, the number resolved by then is

    S = Q + min(0, lowest value that A - Q has had so far)

because a day cannot resolve more than there is. A finding's rank by age lies in
(S of the day before, S] of the day that resolves it: two running totals are
matched by their ranges. Both run over one row for each repository and hour or
day; findings are only numbered inside the hour in which they were first seen
and get their day from the range that begins at or before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_REPOSITORY = "repository_id"


def _hour(at: Column) -> Column:
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("hour", at).cast("timestamp_ntz"))


def _day_end(day: Column) -> Column:
    """The hour with which a day is over."""
    return (F.unix_date(day).cast("long") + 1) * 24


def resolve_oldest(open_findings: DataFrame, quotas: DataFrame, *columns: str) -> DataFrame:
    """The findings with `resolved_on`, null for those that stay open.

    open_findings: repository_id, fingerprint, first_seen_at and the `columns` to keep. quotas: repository_id, day, n;
    several for a day add up. Of findings seen at one time the smaller fingerprint is older; a finding without a time
    is never resolved.
    """
    rows = open_findings.select(_REPOSITORY, "fingerprint", "first_seen_at", *columns).withColumn("hour", _hour(F.col("first_seen_at")))
    seen = rows.where("hour is not null").groupBy(_REPOSITORY, "hour").agg(F.count("*").alias("n"))
    closing = quotas.where("day is not null and n > 0").groupBy(_REPOSITORY, "day").agg(F.sum("n").alias("quota"))
    events = seen.select(_REPOSITORY, "hour", "n", F.lit(0).cast("long").alias("quota"), F.lit(None).cast("date").alias("day")).unionByName(
        closing.select(_REPOSITORY, _day_end(F.col("day")).alias("hour"), F.lit(0).cast("long").alias("n"), "quota", "day")
    )
    # What a day closes comes before what is seen in the hour after it.
    in_time = Window.partitionBy(_REPOSITORY).orderBy("hour", F.col("day").isNull())
    upto = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = events.select("*", F.sum("n").over(upto).alias("a"), F.sum("quota").over(upto).alias("q"))
    totals = totals.withColumn("s", F.col("q") + F.least(F.lit(0), F.min(F.col("a") - F.col("q")).over(upto)))
    totals = totals.withColumn("s_before", F.lag("s", 1, 0).over(in_time))
    # Ranks at which an hour or a day's share begins, and where the last share has ended.
    begins = totals.select(
        _REPOSITORY,
        F.when(F.col("day").isNull(), F.col("a") - F.col("n") + 1).otherwise(F.col("s_before") + 1).alias("rank"),
        F.when(F.col("day").isNull(), F.col("hour")).alias("at_hour"),
        F.when(F.col("day").isNotNull(), F.struct("day")).alias("share"),
    ).where(F.col("at_hour").isNotNull() | (F.col("s") > F.col("s_before")))
    ended = totals.groupBy(_REPOSITORY).agg((F.max("s") + 1).alias("rank")).select(
        _REPOSITORY, "rank", F.lit(None).cast("long").alias("at_hour"), F.struct(F.lit(None).cast("date").alias("day")).alias("share")
    )
    by_rank = Window.partitionBy(_REPOSITORY).orderBy("rank")
    marks = begins.unionByName(ended).select(
        _REPOSITORY, "rank",
        F.last("at_hour", ignorenulls=True).over(by_rank).alias("hour"), F.last("share", ignorenulls=True).over(by_rank).alias("share"),
    ).where("share is not null and hour is not null").distinct()
    offsets = totals.where("day is null").select(_REPOSITORY, "hour", (F.col("a") - F.col("n")).alias("older"))
    in_hour = Window.partitionBy(_REPOSITORY, "hour").orderBy("first_seen_at", "fingerprint")
    ranked = rows.where("hour is not null").withColumn("place", F.row_number().over(in_hour)).join(offsets, [_REPOSITORY, "hour"])
    placed = ranked.withColumn("rank", F.col("older") + F.col("place")).drop("older", "place").withColumn("found", F.lit(True))
    both = placed.unionByName(marks, allowMissingColumns=True)
    carried = Window.partitionBy(_REPOSITORY, "hour").orderBy("rank", F.col("found").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = both.withColumn("share", F.last("share", ignorenulls=True).over(carried)).where("found")
    kept = [_REPOSITORY, "fingerprint", "first_seen_at", *columns]
    undated = rows.where("hour is null").select(*kept, F.lit(None).cast("date").alias("resolved_on"))
    return dated.select(*kept, F.col("share.day").alias("resolved_on")).unionByName(undated)
