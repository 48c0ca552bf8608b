"""Bounded selections over a review's findings: caps, inline plan, triage set.

A review is named by key columns; its findings carry a unique `ord` column that
fixes their order. Selections keep at most N rows per review, and the rank
filter runs before the shuffle as well, so one huge review sends N rows per
task instead of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed_values import patterns as P
from ..fixed_values.enums import SARIF_MAX_RESULTS, SARIF_MAX_RESULTS_PER_RULE, SEVERITIES
from ..functions.dialect import capture
from ..functions.ranks import confidence_rank, severity_at_least, severity_of_rank, severity_rank


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first rows of each group."""
    numbered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(numbered)).where(F.col("_n") <= limit).drop("_n")


def override_severity(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Replace severities by rule id, else by category."""
    if not overrides:
        return findings
    table = F.create_map(*[F.lit(v) for pair in overrides.items() for v in pair])
    chosen = F.coalesce(
        F.try_element_at(table, F.col("rule_id")), F.try_element_at(table, F.col("category")), F.col("severity")
    )
    return findings.withColumn("severity", chosen)


def cap_results(
    findings: DataFrame,
    keys: list[str],
    per_rule: int = SARIF_MAX_RESULTS_PER_RULE,
    total: int = SARIF_MAX_RESULTS,
) -> DataFrame:
    """At most `per_rule` results of a rule and `total` of a run, in order."""
    return first_n(first_n(findings, [*keys, "rule_id"], ["ord"], per_rule), keys, ["ord"], total)


def posted_fingerprints(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints named by the hidden markers of existing comments."""
    marker = capture(F.col("body"), P.COMMENT_MARKER, 1)
    return bodies.select(*keys, marker.alias("fingerprint")).where(F.col("fingerprint") != "").distinct()


def inline_plan(
    findings: DataFrame,
    commentable: DataFrame,
    bodies: DataFrame,
    keys: list[str],
    max_comments: int,
    min_severity: str = SEVERITIES[-1],
) -> DataFrame:
    """Every finding with a `plan`: already, comment or deferred.

    The budget is turned into one boundary per review - the order of the last
    comment that fits - so the findings themselves are not ranked in a window.
    """
    posted = posted_fingerprints(bodies, keys).withColumn("posted", F.lit(True))
    shown = commentable.select(*keys, "file_path", "line").distinct().withColumn("shown", F.lit(True))
    flagged = findings.join(posted, [*keys, "fingerprint"], "left").join(shown, [*keys, "file_path", "line"], "left")
    eligible = (
        F.col("posted").isNull()
        & F.col("shown").isNotNull()
        & ~F.coalesce(F.col("verdict") == "refuted", F.lit(False))
        & severity_at_least(F.col("severity"), min_severity)
    )
    flagged = flagged.withColumn("eligible", eligible)
    fitting = first_n(flagged.where("eligible").select(*keys, "ord"), keys, ["ord"], max_comments)
    boundary = fitting.groupBy(*keys).agg(F.max("ord").alias("last_comment"))
    plan = (
        F.when(F.col("posted").isNotNull(), "already")
        .when(F.col("eligible") & (F.col("ord") <= F.col("last_comment")), "comment")
        .otherwise("deferred")
    )
    return (
        flagged.join(boundary, keys, "left")
        .withColumn("plan", plan)
        .drop("posted", "shown", "eligible", "last_comment")
    )


def select_for_triage(
    findings: DataFrame, keys: list[str], max_findings: int, min_severity: str = SEVERITIES[-1]
) -> DataFrame:
    """Findings worth a second opinion: worst first, least certain first.

    A provider-format credential speaks for itself and is left out.
    """
    evident = (F.col("category") == "secrets") & (F.col("rule_id") != "secrets/hardcoded-credential")
    asked = findings.where(severity_at_least(F.col("severity"), min_severity) & ~evident)
    order = [severity_rank(F.col("severity")), confidence_rank(F.col("confidence")).desc(), F.col("ord")]
    return first_n(asked, keys, order, max_findings)


def adjusted_severity(current: Column, requested: Column, confidence: Column) -> Column:
    """Move at most one step, and only on a confident verdict."""
    start, wanted = severity_rank(current), severity_rank(requested)
    step = F.greatest(start - 1, F.least(start + 1, wanted))
    trusted = (confidence == "high") & requested.isin(*SEVERITIES)
    return F.when(trusted, severity_of_rank(step)).otherwise(current)


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Attach verdicts to findings; a finding without one stays as it was."""
    incoming = verdicts.select(
        *keys, "fingerprint", "verdict", "reasoning", "fix",
        F.col("severity").alias("t_severity"), F.col("confidence").alias("t_confidence"), "model",
    )
    return (
        findings.join(incoming, [*keys, "fingerprint"], "left")
        .withColumn("t_severity", F.when(F.col("verdict").isNotNull(), F.col("t_severity")))
        .withColumn(
            "severity_changed_from",
            F.when(F.col("t_severity") != F.col("severity"), F.col("severity")),
        )
        .withColumn("severity", F.coalesce("t_severity", "severity"))
        .drop("t_severity")
    )


def triage_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count("*").alias("findings"),
        F.count("verdict").alias("triaged"),
        F.count_if(F.col("verdict") == "refuted").alias("refuted"),
    )


def blocking(fail_on: str) -> Column:
    """True for a finding that fails the check."""
    if fail_on == "never":
        return F.lit(False)
    refuted = F.coalesce(F.col("verdict") == "refuted", F.lit(False))
    return ~refuted & severity_at_least(F.col("severity"), fail_on)
