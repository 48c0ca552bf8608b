"""Read-only questions about the finding history.

Every function is `f(store, filter) -> DataFrame`; nothing is folded on the
driver. `as_of` always comes from the caller so a query can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed_values.enums import DEFAULT_WINDOW_DAYS, SEVERITIES, WINDOW_CHOICES
from ..functions.ranks import severity_rank
from ..operators.median import exact_median
from ..sources.tables import Store


@dataclass(frozen=True)
class StatsFilter:
    as_of: datetime
    days: int = DEFAULT_WINDOW_DAYS
    repository: str | None = None

    @property
    def since(self) -> Column:
        """Window start to the second."""
        return F.lit(self.as_of - timedelta(days=self.days)).cast("timestamp_ntz")

    @property
    def first_day(self):
        """First calendar day of a window that includes today."""
        return (self.as_of - timedelta(days=self.days - 1)).date()

    @property
    def first_midnight(self) -> Column:
        return F.lit(datetime.combine(self.first_day, datetime.min.time())).cast("timestamp_ntz")


def window_days(raw: object) -> int:
    """A requested window, or the default when it is not one that is offered."""
    try:
        days = int(str(raw))
    except ValueError:
        return DEFAULT_WINDOW_DAYS
    return days if days in WINDOW_CHOICES else DEFAULT_WINDOW_DAYS


def clamp_limit(raw: object, fallback: int, ceiling: int) -> int:
    try:
        wanted = int(str(raw))
    except ValueError:
        return fallback
    return min(wanted, ceiling) if wanted >= 1 else fallback


def _repos(store: Store, flt: StatsFilter) -> DataFrame:
    repos = store.repositories.select("id", "full_name")
    if flt.repository is None:
        return repos
    return repos.where(F.col("full_name") == flt.repository)


def _state(store: Store, flt: StatsFilter, *columns: str) -> DataFrame:
    """State rows of known repositories; the name filter prunes before the join."""
    repos = _repos(store, flt)
    state = store.finding_state
    joined = state.join(repos, state.repository_id == repos.id)
    return joined.select(*columns) if columns else joined


def open_by_group(store: Store, flt: StatsFilter) -> DataFrame:
    return (
        _state(store, flt)
        .where(F.col("status") == "open")
        .groupBy("severity", "category")
        .agg(F.count("*").alias("count"))
    )


def open_marginals(store: Store, flt: StatsFilter) -> DataFrame:
    """Total, by severity and by category out of one pass (grouping sets)."""
    rows = _state(store, flt).where(F.col("status") == "open")
    sets = rows.groupingSets([[], ["severity"], ["category"]], "severity", "category")
    return sets.agg(
        F.count("*").alias("count"), F.grouping_id("severity", "category").alias("gid")
    ).select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "severity").otherwise("category").alias("dimension"),
        F.coalesce("severity", "category", F.lit("all")).alias("value"),
        "count",
    )


def _seconds_between(start: str, end: str) -> Column:
    return F.timestamp_diff("SECOND", F.col(start), F.col(end))


def overview(store: Store, flt: StatsFilter) -> DataFrame:
    """One row: balances, window counts, mean time to resolve, median open age.

    Equal rows are counted once, by keys that both the measures and the median
    need whole, so the two share one reading of the state.
    """
    is_open = F.col("status") == "open"
    rows = _state(store, flt).groupBy(
        "repository_id", "status", "severity", "category", "first_seen_at", "resolved_at"
    ).agg(F.count("*").alias("n"))

    def counted(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    resolved = F.col("resolved_at").isNotNull()
    seconds = F.sum(F.when(resolved, F.col("n") * _seconds_between("first_seen_at", "resolved_at")))
    measures = [
        counted(is_open).alias("total_open"),
        counted(F.col("status") == "resolved").alias("total_resolved"),
        *[counted(is_open & (F.col("severity") == s)).alias(f"open_severity_{s}") for s in SEVERITIES],
        *[
            counted(is_open & (F.col("category") == c)).alias(f"open_category_{c.lower().replace('-', '_')}")
            for c in store.categories
        ],
        F.count_distinct("repository_id").alias("repositories_tracked"),
        counted(F.col("first_seen_at") >= flt.since).alias("introduced_in_window"),
        counted(F.col("resolved_at") >= flt.since).alias("resolved_in_window"),
        F.round(seconds / F.sum(F.when(resolved, F.col("n"))) / 3600.0, 1).alias("mean_time_to_resolve_hours"),
    ]
    repos = _repos(store, flt).select(F.col("id").alias("rid"))
    in_window = store.scans.join(repos, F.col("repository_id") == F.col("rid")).agg(F.count_if(F.col("created_at") >= flt.since).alias("scans_in_window"))
    median = exact_median(rows, "first_seen_at", flt.as_of, F.when(is_open, F.col("n")))
    return rows.agg(*measures).select(
        "*",
        in_window.scalar().alias("scans_in_window"),
        median.scalar().alias("median_open_age_days"),
    )


def day_spine(store: Store, flt: StatsFilter) -> DataFrame:
    """UTC days of the window, oldest first, today included."""
    spark = store.repositories.sparkSession
    first, last = F.lit(flt.first_day), F.lit(flt.as_of.date())
    return spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("date"))


def trend(store: Store, flt: StatsFilter, by_severity: bool = False) -> DataFrame:
    """Introduced, resolved and the running open balance for each day.

    The balance may not go below zero. With P the unclamped running balance,
    the clamped one is P minus the lowest value P has reached below zero.

    One pass: a state row turns into its dated events - introduced, resolved,
    or carried into the first day - and those collapse to one row per day on
    the map side. The window then runs over at most `days` rows.
    """
    start = flt.first_midnight
    first, gone = F.col("first_seen_at"), F.col("resolved_at")
    known = F.col("severity").isin(*SEVERITIES)
    no_text = F.lit(None).cast("string")

    def event(kind: str, date: Column, severity: Column = no_text) -> Column:
        return F.struct(F.lit(kind).alias("kind"), date.alias("date"), severity.alias("severity"))

    dated = F.array(
        event("introduced", F.when((first >= start) & known, F.to_date(first)), F.col("severity")),
        event("resolved", F.when(gone >= start, F.to_date(gone))),
        event("carried", F.when((first < start) & (gone.isNull() | (gone >= start)), F.lit(flt.first_day))),
    )
    per_day = (
        _state(store, flt, "first_seen_at", "resolved_at", "severity")
        .select(F.explode(dated).alias("e"))
        .where("e.date is not null")
        .groupBy("e.date")
        .agg(
            *[F.count_if(F.col("e.kind") == kind).alias(kind) for kind in ("introduced", "resolved", "carried")],
            *[F.count_if((F.col("e.kind") == "introduced") & (F.col("e.severity") == s)).alias(s) for s in SEVERITIES],
        )
    )
    return balance(per_day, store, flt, by_severity)


def balance(per_day: DataFrame, store: Store, flt: StatsFilter, by_severity: bool) -> DataFrame:
    """A row for each day of the window from the days in which anything happened (introduced, resolved, carried, severities)."""
    daily = day_spine(store, flt).join(per_day, "date", "left").na.fill(
        0, ["introduced", "resolved", "carried", *SEVERITIES]
    )
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = F.col("carried") + F.col("introduced") - F.col("resolved")
    moving = daily.withColumn("p", F.sum(moved).over(running))
    out = moving.withColumn("open", F.col("p") - F.least(F.lit(0), F.min("p").over(running)))
    columns = ["date", "introduced", "resolved", "open"]
    return out.select(*columns, *(SEVERITIES if by_severity else ()))


def category_trend(store: Store, flt: StatsFilter) -> DataFrame:
    counts = (
        _state(store, flt)
        .where(F.col("first_seen_at") >= flt.first_midnight)
        .groupBy(F.to_date("first_seen_at").alias("date"))
        .agg(
            *[
                F.count_if(F.col("category") == c).alias(c.lower().replace("-", "_"))
                for c in store.categories
            ]
        )
    )
    names = [c.lower().replace("-", "_") for c in store.categories]
    return day_spine(store, flt).join(counts, "date", "left").na.fill(0, names)


def top_rules(store: Store, flt: StatsFilter, limit: int = 10) -> DataFrame:
    return (
        _state(store, flt)
        .groupBy("rule_id", "category", "severity")
        .agg(F.count_if(F.col("status") == "open").alias("open"), F.count("*").alias("total"))
        .orderBy(F.desc("open"), F.desc("total"), "rule_id", "category", "severity")
        .limit(limit)
    )


def repository_summaries(store: Store, limit: int = 20) -> DataFrame:
    """Per repository open counts and scan facts; both facts aggregated first."""
    is_open = F.col("status") == "open"
    counts = store.finding_state.groupBy("repository_id").agg(
        F.count_if(is_open).alias("open"),
        F.count_if(is_open & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(is_open & (F.col("severity") == "high")).alias("high"),
    )
    runs = store.scans.groupBy(F.col("repository_id").alias("scan_repo")).agg(
        F.max("created_at").alias("last_scan_at"), F.count("*").alias("scans")
    )
    repos = store.repositories.select("id", "full_name")
    return (
        repos.join(counts, repos.id == counts.repository_id, "left")
        .join(runs, repos.id == runs.scan_repo, "left")
        .na.fill(0, ["open", "critical", "high", "scans"])
        .orderBy(F.desc("critical"), F.desc("high"), F.desc("open"), "full_name")
        .limit(limit)
        .select("full_name", "open", "critical", "high", "last_scan_at", "scans")
    )


def recent_scans(store: Store, flt: StatsFilter, limit: int = 15) -> DataFrame:
    repos = _repos(store, flt).select(F.col("id").alias("rid"), F.col("full_name").alias("repository"))
    return (
        store.scans.join(repos, F.col("repository_id") == F.col("rid"))
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
        .select(
            "id", "repository", "pull_request_number", "head_sha", "title", "author", "findings_count",
            "new_findings_count", "resolved_findings_count", "files_scanned", "duration_ms", "created_at",
        )
    )


def open_findings(store: Store, flt: StatsFilter, limit: int = 50) -> DataFrame:
    as_of = F.lit(flt.as_of).cast("timestamp_ntz")
    return (
        _state(store, flt)
        .where(F.col("status") == "open")
        .orderBy(severity_rank(F.col("severity")), "first_seen_at", "repository_id", "fingerprint")
        .limit(limit)
        .select(
            "fingerprint",
            F.col("full_name").alias("repository"),
            "rule_id",
            "category",
            "severity",
            "title",
            "file_path",
            "first_seen_at",
            "last_seen_at",
            (F.timestamp_diff("SECOND", F.col("first_seen_at"), as_of) / 86400).cast("int").alias("age_days"),
        )
    )


def _judged(store: Store, flt: StatsFilter) -> DataFrame:
    return _state(store, flt).where(F.col("verdict").isNotNull() & (F.col("first_seen_at") >= flt.since))


def triage_by_verdict(store: Store, flt: StatsFilter) -> DataFrame:
    return _judged(store, flt).groupBy("verdict").agg(F.count("*").alias("count"))


def triage_accuracy(store: Store, flt: StatsFilter) -> DataFrame:
    """One row: judged, refuted, and the refutation rate (null when none judged)."""
    refuted = F.count_if(F.col("verdict") == "refuted")
    return _judged(store, flt).agg(F.count("*").alias("judged"), refuted.alias("refuted")).select(
        "judged",
        "refuted",
        F.when(F.col("judged") > 0, F.col("refuted") / F.col("judged")).alias("refutation_rate"),
    )


def noisiest_rules(store: Store, flt: StatsFilter, min_judged: int = 3, limit: int = 8) -> DataFrame:
    return (
        _judged(store, flt)
        .groupBy("rule_id")
        .agg(F.count("*").alias("judged"), F.count_if(F.col("verdict") == "refuted").alias("refuted"))
        .where((F.col("judged") >= min_judged) & (F.col("refuted") > 0))
        .withColumn("refutation_rate", F.col("refuted") / F.col("judged"))
        .orderBy(F.desc("refutation_rate"), F.desc("refuted"), "rule_id")
        .limit(limit)
    )


def known_repositories(store: Store) -> DataFrame:
    return store.repositories.select("full_name").orderBy("full_name")
