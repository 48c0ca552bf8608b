"""Reading verdicts out of model answers, and validating each of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values.enums import CONFIDENCES, VERDICTS
from ..functions.text import strip
from .planning import adjusted_severity

_FIELDS = ("fingerprint", "verdict", "reasoning", "fix", "severity", "confidence")


def first_json_object(text: Column) -> Column:
    """The first balanced JSON object of a text; null when it does not parse.

    Brace matching that respects strings is not a regular language, so this one
    step runs in Arrow batches. The function is local, so it travels to the
    executors by value.
    """

    @F.pandas_udf(T.StringType())
    def extract(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def first(value: str | None) -> str | None:
            at = -1 if value is None else value.find("{")
            if at < 0:
                return None
            try:
                return json.dumps(decoder.raw_decode(value, at)[0])
            except ValueError:
                return None

        return texts.map(first)

    return extract(text)


def _listed(answer: Column) -> Column:
    """The items of an answer's list, whatever each of them is."""
    return F.try_variant_get(F.try_parse_json(answer), "$.findings", "array<variant>")


def _text_of(item: str, field: str) -> Column:
    """A field of an item that is an object, if it is a string; a number is no text."""
    value = F.try_variant_get(F.col(item), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.col(item), f"$.{field}", "string"))


def parse_verdicts(answers: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Valid verdicts for findings that were asked about.

    answers: keys, tool_json, text, model. The tool call's list wins; free text
    is searched only without one. Items are read one by one: what is no object,
    an unknown fingerprint, a verdict outside the scale or a reasoning that is
    no text or blank drops that item and no other; a strange confidence becomes medium;
    the last verdict on a fingerprint counts.
    """
    from_tool = _listed(F.col("tool_json"))
    from_text = _listed(F.when(F.contains("text", F.lit("{")), first_json_object(F.col("text"))))
    found = answers.select(*keys, "model", F.posexplode(F.coalesce(from_tool, from_text)).alias("at", "item"))
    items = found.select(*keys, "model", "at", F.struct(*(_text_of("item", f).alias(f) for f in _FIELDS)).alias("v"))
    confidence = F.when(F.col("v.confidence").isin(*CONFIDENCES), F.col("v.confidence")).otherwise("medium")
    usable = items.select(
        *keys, "model", "at", F.col("v.fingerprint").alias("fingerprint"), F.col("v.verdict").alias("verdict"),
        strip(F.col("v.reasoning")).alias("reasoning"), F.nullif(strip(F.col("v.fix")), F.lit("")).alias("fix"),
        F.col("v.severity").alias("requested"), confidence.alias("confidence"),
    ).where(F.col("verdict").isin(*VERDICTS) & (F.col("reasoning") != ""))
    last = usable.groupBy(*keys, "fingerprint").agg(
        F.max_by(F.struct("verdict", "reasoning", "fix", "requested", "confidence", "model"), "at").alias("v")
    )
    known = asked.select(*keys, "fingerprint", F.col("severity").alias("asked_severity"))
    settled = adjusted_severity(F.col("asked_severity"), F.col("v.requested"), F.col("v.confidence"))
    return last.join(known, [*keys, "fingerprint"]).select(
        *keys, "fingerprint", "v.verdict", "v.reasoning", "v.fix", settled.alias("severity"),
        F.when(settled != F.col("asked_severity"), F.col("asked_severity")).alias("severity_changed_from"),
        "v.confidence", "v.model",
    )
