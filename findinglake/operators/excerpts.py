"""Source windows around findings: merged, numbered, cut off and scrubbed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import confidence_rank, severity_rank
from ..functions.scrub import scrub_credentials


def merged_windows(findings: DataFrame, lengths: DataFrame, keys: list[str], context: int) -> DataFrame:
    """Line ranges per file after overlapping and touching ones are joined.

    Windows with the same start collapse to the longest before they are
    ordered, so a file contributes at most one row per line to its window.
    """
    end = F.coalesce("end_line", "line")
    ranges = (
        findings.join(lengths.select(*keys, "n_lines"), keys)
        .select(
            *keys,
            F.greatest(F.lit(1), F.col("line") - context).alias("start"),
            F.least("n_lines", end + context).alias("stop"),
        )
        .where(F.col("start") <= F.col("stop"))
        .groupBy(*keys, "start")
        .agg(F.max("stop").alias("stop"))
    )
    ordered = Window.partitionBy(*keys).orderBy("start")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("stop").over(before)
    opens = F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0)
    return (
        ranges.withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(upto))
        .groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )


def clipped_windows(windows: DataFrame, keys: list[str], max_lines: int) -> DataFrame:
    """The windows that fit into the line budget of their file."""
    size = F.col("stop") - F.col("start") + 1
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(size).over(before), F.lit(0))
    whole = Window.partitionBy(*keys)
    return (
        windows.withColumn("used", used)
        .withColumn("wanted", F.sum(size).over(whole))
        .where(F.col("used") < max_lines)
        .withColumn("stop", F.least(F.col("stop"), (F.col("start") + max_lines - F.col("used") - 1)).cast("int"))
        .withColumn("truncated", F.col("wanted") > max_lines)
        .select(*keys, "island", "start", "stop", "truncated")
    )


def excerpts(files: DataFrame, findings: DataFrame, keys: list[str], context: int, max_lines: int) -> DataFrame:
    """One scrubbed excerpt per file with findings. files: keys, content."""
    lines = F.split("content", "\n")
    lengths = files.select(*keys, F.size(lines).alias("n_lines"))
    kept = clipped_windows(merged_windows(findings, lengths, keys, context), keys, max_lines)
    plans = kept.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("windows"),
        F.bool_or("truncated").alias("truncated"),
        F.min("start").alias("start_line"),
        F.max("stop").alias("end_line"),
    )
    body = F.array_join(
        F.transform(
            "windows",
            lambda w: F.array_join(
                F.transform(
                    F.sequence(w["start"], w["stop"]),
                    lambda n: F.concat(
                        F.when(n < 10000, F.lpad(n.cast("string"), 5, " ")).otherwise(n.cast("string")),
                        F.lit("  "), F.coalesce(F.get(F.col("lines"), n - 1), F.lit("")),
                    ),
                ),
                "\n",
            ),
        ),
        "\n    ...\n",
    )
    tail = F.when(F.col("truncated"), F.lit("\n    ... (excerpt truncated)")).otherwise(F.lit(""))
    return (
        files.select(*keys, lines.alias("lines"))
        .join(plans, keys)
        .select(*keys, scrub_credentials(F.concat(body, tail)).alias("text"), "start_line", "end_line", "truncated")
    )


def triage_requests(files: DataFrame, chosen: DataFrame, keys: list[str], context: int, max_lines: int) -> DataFrame:
    """One row per file with findings to judge: keys, `excerpt` and `findings`, worst and least certain first.

    `chosen` comes from `select_for_triage`, whose limit bounds the list of a file.
    """
    order = F.struct(
        severity_rank(F.col("severity")).alias("s"), (-confidence_rank(F.col("confidence"))).alias("c"), F.col("ord").alias("o"),
        "fingerprint", "rule_id", "severity", "confidence", "line",
    )
    listed = chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("all"))
    named = F.transform("all", lambda f: F.struct(*(f[n].alias(n) for n in ("fingerprint", "rule_id", "severity", "confidence", "line"))))
    places = chosen.select(*keys, "line", F.lit(None).cast("int").alias("end_line"))
    cut = excerpts(files, places, keys, context, max_lines)
    return cut.join(listed, keys).select(*keys, F.col("text").alias("excerpt"), "start_line", "end_line", "truncated", named.alias("findings"))
