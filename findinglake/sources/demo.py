"""A repeatable demo history: which rule fires where on which day.

Every value is a hash of the row number and a seed, so any number of rows is
made in parallel and a rerun gives the same ones.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values.rules import ALL_RULES
from ..functions.text import fingerprint

_FILES = 40


def _draw(seed: int, name: str, below: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(name)), F.lit(below))


def demo_sightings(
    spark: SparkSession, as_of: datetime, days: int = 90, repositories: int = 3, per_day: int = 20, seed: int = 1
) -> DataFrame:
    """Sightings of the last `days` days; common rules are drawn more often."""
    # Low-severity rules weigh more, as they do in practice.
    weights = {"critical": 1, "high": 2, "medium": 3, "low": 4, "info": 4}
    deck = [r for r in ALL_RULES for _ in range(weights[r.severity])]
    card = F.get(
        F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title")) for r in deck]),
        _draw(seed, "rule", len(deck)).cast("int"),
    )
    path = F.concat(F.lit("src/f"), _draw(seed, "file", _FILES).cast("string"), F.lit(".py"))
    day = (F.col("id") / per_day).cast("int")
    rows = spark.range(days * per_day).select(
        F.concat(F.lit("demo/repo"), _draw(seed, "repo", repositories).cast("string")).alias("full_name"),
        F.col("id").alias("seq"), card.alias("card"), path.alias("file_path"),
        (_draw(seed, "line", 400) + 1).cast("int").alias("line"),
        F.date_sub(F.lit(as_of.date()), F.lit(days - 1) - day).alias("seen_on"),
    )
    return rows.select(
        "full_name", "seq", "card.*", F.substring_index("card.rule_id", "/", 1).alias("category"), "file_path", "line",
        "seen_on", fingerprint(F.col("card.rule_id"), F.col("file_path"), F.col("line").cast("string")).alias("fingerprint"),
    )
