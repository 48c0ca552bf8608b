"""Report shapes: SARIF, commit status, comment and terminal text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed_values import enums as E
from ..fixed_values.rules import RULE_ORDER
from ..functions.ranks import choose, lookup, severity_of_rank, severity_rank
from ..functions.text import duration_text, escape_cell, pascal_case, plural
from ..operators.planning import blocking, cap_results

SEVERITY_ICONS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
VERDICT_LABELS = {
    "confirmed": "Confirmed on review",
    "likely": "Probably real",
    "unclear": "Needs a human",
    "refuted": "Judged a false positive",
}


def level(severity: Column) -> Column:
    return F.coalesce(lookup(E.SARIF_LEVELS, severity), F.lit("none"))


def sarif_message(title: Column, why: Column, verdict: Column, reasoning: Column) -> Column:
    return choose(
        [
            (verdict.isNull(), F.concat(title, F.lit(". "), why)),
            (
                verdict == "refuted",
                F.concat(title, F.lit(". Judged a false positive on review: "), reasoning,
                         F.lit(" The rule's general concern: "), why),
            ),
        ],
        F.concat(title, F.lit(". "), reasoning),
    )


def sarif_rules(capped: DataFrame, keys: list[str]) -> DataFrame:
    """Rule metadata of the rules that fired, numbered in id order per run.

    The rule takes its worst severity; text and confidence come from its first
    result. The index window runs over the rules of a run, not its results.
    """
    first = F.struct("title", "description", "remediation", "category", "confidence", "cwe")
    rules = capped.groupBy(*keys, "rule_id").agg(
        F.min(severity_rank(F.col("severity"))).alias("worst_rank"),
        F.min_by(first, "ord").alias("example"),
        F.count("*").alias("results"),
    )
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("rule_id")) - 1
    worst = severity_of_rank(F.col("worst_rank"))
    family = F.substring_index("rule_id", "/", 1)
    return rules.select(
        *keys,
        "rule_id",
        index.alias("rule_index"),
        pascal_case(F.col("rule_id")).alias("name"),
        level(worst).alias("level"),
        lookup(E.SARIF_SCORES, worst).alias("security_severity"),
        F.col("example.confidence").alias("precision"),
        F.col("example.category").alias("category"),
        F.when(family.isin(*RULE_ORDER), family).alias("analyzer"),
        F.col("example.title").alias("title"),
        F.col("example.description").alias("description"),
        F.col("example.remediation").alias("remediation"),
        F.concat(
            F.array(F.lit("security"), F.concat(F.lit("category/"), "example.category")),
            F.transform(
                F.coalesce("example.cwe", F.array().cast("array<string>")),
                lambda c: F.concat(F.lit("external/cwe/"), F.regexp_replace(F.lower(c), r"\s+", "")),
            ),
        ).alias("tags"),
        "results",
    )


def sarif_results(capped: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """One row per reported result with its rule index and SARIF fields."""
    indexed = capped.join(rules.select(*keys, "rule_id", "rule_index"), [*keys, "rule_id"])
    return indexed.select(
        *keys, "ord", "rule_id", "rule_index", level(F.col("severity")).alias("level"),
        sarif_message(F.col("title"), F.col("description"), F.col("verdict"), F.col("reasoning")).alias("message"),
        "file_path",
        F.greatest(F.lit(1), F.col("line")).alias("start_line"),
        F.when(F.col("end_line") > F.col("line"), F.col("end_line")).alias("end_line"),
        "snippet", "fingerprint", "severity", "confidence", "category", "verdict", "triage_confidence", "model",
    )


def _result_object(r: Column) -> Column:
    reviewed = r["verdict"].isNotNull()
    return F.struct(
        r["rule_id"].alias("ruleId"),
        r["rule_index"].alias("ruleIndex"),
        r["level"].alias("level"),
        F.struct(r["message"].alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(r["file_path"].alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
                    F.struct(
                        r["start_line"].alias("startLine"), r["end_line"].alias("endLine"),
                        F.struct(r["snippet"].alias("text")).alias("snippet"),
                    ).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(r["fingerprint"].alias("securityReviewFingerprint")).alias("partialFingerprints"),
        F.struct(
            r["severity"].alias("severity"), r["confidence"].alias("confidence"), r["category"].alias("category"),
            F.when(reviewed, r["verdict"]).alias("reviewVerdict"),
            F.when(reviewed, r["triage_confidence"]).alias("reviewConfidence"),
            F.when(reviewed, r["model"]).alias("reviewModel"),
        ).alias("properties"),
    )


def _rule_object(r: Column) -> Column:
    advice = F.concat(r["description"], F.lit("\n\nHow to fix: "), r["remediation"])
    return F.struct(
        r["rule_id"].alias("id"),
        r["name"].alias("name"),
        F.struct(r["title"].alias("text")).alias("shortDescription"),
        F.struct(r["description"].alias("text")).alias("fullDescription"),
        F.struct(advice.alias("text")).alias("help"),
        F.struct(r["level"].alias("level")).alias("defaultConfiguration"),
        F.struct(
            r["tags"].alias("tags"), r["precision"].alias("precision"),
            r["security_severity"].alias("security-severity"),
            F.coalesce(lookup(E.CATEGORY_LABELS, r["category"]), r["category"]).alias("category"),
            r["analyzer"].alias("analyzer"),
        ).alias("properties"),
    )


def sarif_documents(
    findings: DataFrame, keys: list[str], tool: str, version: str, uri: str
) -> DataFrame:
    """One SARIF JSON text per run. A run's results are bounded by the caps
    before they are gathered, and a run that was cut says so."""
    capped = cap_results(findings, keys)
    rules = sarif_rules(capped, keys)
    results = sarif_results(capped, rules, keys)
    rule_lists = rules.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rule_index", F.struct(*[c for c in rules.columns if c not in keys]).alias("r")))).alias("rules")
    )
    columns = [c for c in results.columns if c not in keys]
    result_lists = results.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("results"), F.count("*").alias("reported")
    )
    totals = findings.groupBy(*keys).agg(F.count("*").alias("found"))
    omitted = F.col("found") - F.col("reported")
    notice = F.struct(
        F.lit(True).alias("executionSuccessful"),
        F.array(
            F.struct(
                F.lit("warning").alias("level"),
                F.struct(
                    F.concat(
                        omitted.cast("string"),
                        F.lit(f" findings left out: at most {E.SARIF_MAX_RESULTS} per run and "
                              f"{E.SARIF_MAX_RESULTS_PER_RULE} per rule are reported."),
                    ).alias("text")
                ).alias("message"),
            )
        ).alias("toolExecutionNotifications"),
    )
    run = F.struct(
        F.struct(
            F.struct(
                F.lit(tool).alias("name"), F.lit(version).alias("version"), F.lit(uri).alias("informationUri"),
                F.transform("rules", lambda x: _rule_object(x["r"])).alias("rules"),
            ).alias("driver")
        ).alias("tool"),
        F.transform("results", _result_object).alias("results"),
        F.when(omitted > 0, F.array(notice)).alias("invocations"),
    )
    document = F.struct(
        F.lit(E.SARIF_SCHEMA).alias("$schema"), F.lit(E.SARIF_VERSION).alias("version"), F.array(run).alias("runs")
    )
    return rule_lists.join(result_lists, keys).join(totals, keys).select(*keys, F.to_json(document).alias("sarif"))


def severity_tally(keys: list[str], findings: DataFrame, *more: Column) -> DataFrame:
    """Counts of the findings that are not refuted, by severity, per review; `more` is counted in the same pass."""
    refuted = F.coalesce(F.col("verdict") == "refuted", F.lit(False))
    return findings.groupBy(*keys).agg(
        *[F.count_if(~refuted & (F.col("severity") == s)).alias(s) for s in E.SEVERITIES],
        F.count_if(~refuted).alias("active"),
        F.count_if(refuted).alias("refuted"),
        F.min(F.when(~refuted, severity_rank(F.col("severity")))).alias("worst_rank"),
        *more,
    )


def status_lines(findings: DataFrame, keys: list[str], fail_on: str) -> DataFrame:
    """The one-line commit status of each review."""
    counts = severity_tally(keys, findings, F.count_if(blocking(fail_on)).alias("blocking"))
    shown = F.array_compact(
        F.array(*[F.when(F.col(s) > 0, F.concat_ws(" ", F.col(s).cast("string"), F.lit(s))) for s in E.SEVERITIES])
    )
    verdict = F.when(F.col("blocking") > 0, F.concat(F.col("blocking").cast("string"), F.lit(" blocking"))).otherwise(
        F.lit("none blocking")
    )
    text = F.when(F.col("active") == 0, F.lit("No security findings on the changed lines")).otherwise(
        F.substring(F.concat(F.array_join(shown, ", "), F.lit(" ("), verdict, F.lit(")")), 1, E.STATUS_CHARS)
    )
    state = F.when(F.col("blocking") > 0, "failure").otherwise("success")
    return counts.select(*keys, *E.SEVERITIES, "active", "refuted", "blocking", state.alias("state"), text.alias("text"))


def marker(fingerprint: Column) -> Column:
    return F.concat(F.lit("<!-- security-review:finding:"), fingerprint, F.lit(" -->"))


def inline_bodies(plan: DataFrame) -> DataFrame:
    """Text of the comments an inline plan wants posted."""
    icon = lookup(SEVERITY_ICONS, F.col("severity"))
    body = F.concat_ws(
        "\n\n",
        F.concat(marker(F.col("fingerprint")), F.lit("\n"), icon, F.lit(" **"), "title", F.lit("**")),
        F.coalesce("reasoning", "description"),
        F.concat(F.lit("**Fix.** "), F.coalesce("fix", "remediation")),
        F.concat(F.lit("<sub>"), F.concat_ws(" · ", F.concat("severity", F.lit(" severity")),
                 F.coalesce(lookup(E.CATEGORY_LABELS, F.col("category")), F.col("category")), "rule_id"), F.lit("</sub>")),
    )
    return plan.where(F.col("plan") == "comment").withColumn("body", body)


def table_rows(findings: DataFrame, keys: list[str], limit: int = 50) -> DataFrame:
    """Lower-severity findings as table lines, the first of each review, with
    the number left out."""
    lower = findings.where(
        ~F.col("severity").isin("critical", "high") & ~F.coalesce(F.col("verdict") == "refuted", F.lit(False))
    )
    from ..operators.planning import first_n

    totals = lower.groupBy(*keys).agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("hidden"))
    cell = F.concat_ws(
        " | ", "severity", escape_cell(F.col("title")),
        F.concat_ws(":", escape_cell(F.col("file_path")), F.col("line").cast("string")), "rule_id",
    )
    shown = first_n(lower, keys, ["ord"], limit)
    return shown.join(totals, keys).select(*keys, "ord", cell.alias("row"), "hidden")


def headline(active: Column) -> Column:
    return F.concat(F.lit("Security review: "), active.cast("string"), F.lit(" "), plural(active, "finding"))


def detailed_text() -> Column:
    """A finding in full, as markdown: what, where, the line, why and what to do."""
    judged = F.col("verdict").isNotNull()
    place = F.concat(F.lit("`"), "file_path", F.lit(":"), F.col("line").cast("string"), F.lit("`"))
    opinion = lookup(VERDICT_LABELS, F.col("verdict"))
    moved = F.concat(opinion, F.lit(" (severity was "), "severity_changed_from", F.lit(")"))
    facts = F.concat_ws(
        " · ", place, F.coalesce(lookup(E.CATEGORY_LABELS, F.col("category")), F.col("category")),
        F.concat("severity", F.lit(" severity")), F.concat("confidence", F.lit(" confidence")), F.coalesce(moved, opinion),
        F.when(F.col("is_new"), F.lit("new in this change")), F.when(F.size("cwe") > 0, F.array_join("cwe", ", ")),
    )
    doubt = F.when(
        ~judged & (F.col("confidence") == "low"),
        F.concat(F.lit("_Low confidence: if the code around it handles this, write `security-review-ignore "), "rule_id",
                 F.lit("` and a reason on the line above._")),
    )
    source = F.concat(
        F.lit("<sub>"), "rule_id", F.lit(" · "), "fingerprint",
        F.when(judged, F.concat(F.lit(" · judged by "), "model")).otherwise(F.lit("")), F.lit("</sub>"),
    )
    return F.concat_ws(
        "\n\n", F.concat(F.lit("### "), lookup(SEVERITY_ICONS, F.col("severity")), F.lit(" "), "title"), facts,
        F.concat(F.lit("```\n"), "snippet", F.lit("\n```")), F.when(judged, F.col("reasoning")).otherwise(F.col("description")),
        F.concat(F.lit("**Fix.** "), F.coalesce("fix", "remediation")),
        F.when(judged, F.concat(F.lit("In general: "), "description", F.lit(" "), "remediation")), doubt, source,
    )


def review_comments(
    findings: DataFrame, reviews: DataFrame, keys: list[str], fail_on: str, details: int = E.MAX_RENDERED, rows: int = 50
) -> DataFrame:
    """The summary comment of each review: `body`, and how many findings each part leaves out.

    findings: finding and verdict columns, `ord`, `is_new`. reviews: keys, files_scanned, duration_ms, resolved,
    n_inline. Severe findings stand in full, up to `details`; others and refuted ones as lists of `rows` at most.
    """
    refuted = F.coalesce(F.col("verdict") == "refuted", F.lit(False))
    severe = F.col("severity").isin("critical", "high")
    part = F.when(refuted, "refuted").when(severe, "severe").otherwise("other")
    cell = F.concat(
        F.lit("| "), F.concat_ws(
            " | ", F.concat_ws(" ", lookup(SEVERITY_ICONS, F.col("severity")), "severity"), escape_cell(F.col("title")),
            F.concat(F.lit("`"), escape_cell(F.col("file_path")), F.lit(":"), F.col("line").cast("string"), F.lit("`")), "rule_id",
        ), F.lit(" |"),
    )
    overruled = F.concat(
        F.lit("- `"), escape_cell(F.col("file_path")), F.lit(":"), F.col("line").cast("string"), F.lit("` "),
        escape_cell(F.col("title")), F.lit(": "), F.coalesce("reasoning", F.lit("")),
    )
    text = F.when(F.col("part") == "refuted", overruled).when(F.col("part") == "severe", detailed_text()).otherwise(cell)
    place = Window.partitionBy(*keys, "part").orderBy("ord")
    shown = (
        findings.withColumn("part", part).withColumn("n", F.row_number().over(place)).where(F.col("n") <= max(details, rows))
        .where((F.col("part") != "severe") & (F.col("n") <= rows) | (F.col("part") == "severe") & (F.col("n") <= details))
        .select(*keys, "part", "n", text.alias("text"))
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "n", "text"))).alias("shown"))
    )
    counts = severity_tally(
        keys, findings, F.count_if(blocking(fail_on)).alias("blocking"),
        F.count_if(~refuted & severe).alias("severe"), F.count_if(~refuted & ~severe).alias("other"),
    )
    zero = ["active", "refuted", "blocking", "severe", "other", *E.SEVERITIES]
    all_ = reviews.join(counts, keys, "left").join(shown, keys, "left").na.fill(0, zero)

    def listed(name: str, glue: str) -> Column:
        return F.array_join(F.transform(F.filter("shown", lambda x: x["part"] == name), lambda x: x["text"]), glue)

    def left_out(name: str, limit: int) -> Column:
        return F.greatest(F.col(name) - limit, F.lit(0))

    def count_of(number: Column, word: str) -> Column:
        return F.concat_ws(" ", number.cast("string"), plural(number, word))

    tally = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(s) > 0, F.concat_ws(" ", F.lit(SEVERITY_ICONS[s]), F.col(s).cast("string"), F.lit(s))) for s in E.SEVERITIES
    ])), " · ")
    clean = F.concat(
        F.lit("No findings on the changed lines of "), count_of(F.col("files_scanned"), "file"), F.lit(", in "),
        duration_text(F.col("duration_ms")), F.lit("."),
    )
    hidden = left_out("severe", details)
    body = F.concat_ws(
        "\n\n", F.concat(F.lit("## "), headline(F.col("active"))), F.when(F.col("active") == 0, clean).otherwise(tally),
        F.when(F.col("blocking") > 0, F.concat(F.lit("> "), count_of(F.col("blocking"), "finding"), F.lit(f" at {fail_on} or worse: the check fails."))),
        F.when((F.col("active") > 0) & (F.col("n_inline") > 0), F.concat(count_of(F.col("n_inline"), "finding"), F.lit(" commented inline too."))),
        F.when(F.col("severe") > 0, listed("severe", "\n\n")),
        F.when(hidden > 0, F.concat(F.lit("_"), hidden.cast("string"), F.lit(" more of high severity left out._"))),
        F.when(F.col("other") > 0, F.concat(F.lit("| Severity | Finding | Place | Rule |\n| --- | --- | --- | --- |\n"), listed("other", "\n"))),
        F.when(left_out("other", rows) > 0, F.concat(F.lit("_and "), left_out("other", rows).cast("string"), F.lit(" more._"))),
        F.when(F.col("resolved") > 0, F.concat(count_of(F.col("resolved"), "earlier finding"), F.lit(" resolved."))),
        F.when(F.col("refuted") > 0, F.concat(F.lit("Judged false positives:\n"), listed("refuted", "\n"))),
        F.when(left_out("refuted", rows) > 0, F.concat(F.lit("_and "), left_out("refuted", rows).cast("string"), F.lit(" more._"))),
    )
    return all_.select(
        *keys, body.alias("body"), hidden.alias("hidden_severe"), left_out("other", rows).alias("hidden_other"),
        left_out("refuted", rows).alias("hidden_refuted"),
    )
