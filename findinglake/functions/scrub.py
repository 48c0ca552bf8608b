"""Credential removal from text, and key-aware redaction of log values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import credentials as C
from .dialect import bind, matches, substitute
from .prefilter import may_match


def _masked(text: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    """Replace, but only in a text that holds a literal the pattern needs: most
    texts hold none and skip the match."""
    possible = may_match(F.lower(text), pattern)
    return F.when(possible, substitute(text, pattern, replacement, ignore_case)).otherwise(text)


def _in_turn(text: Column, steps: list[tuple[str, str, bool]]) -> Column:
    """Apply the replacements one after another, each on the bound result of
    the one before, so no step is worked out twice."""
    if not steps:
        return text
    (pattern, replacement, ignore_case), *rest = steps
    return bind(text, lambda t: _in_turn(_masked(t, pattern, replacement, ignore_case), rest))


def scrub_credentials(text: Column) -> Column:
    steps = [(pattern, C.MASK, False) for pattern in C.PROVIDER_TOKENS]
    steps.append((C.ASSIGNED_SECRET, "$1$2" + C.MASK + "$2", True))
    steps.append((C.URL_PASSWORD, "$1" + C.MASK + "$3", True))
    return _in_turn(text, steps)


def redact_text(text: Column) -> Column:
    return _in_turn(text, [(pattern, C.MASK, False) for pattern in C.LOG_VALUES])


def redact(value: Column, data_type: T.DataType, depth: int = 0) -> Column:
    """Mask by value everywhere and by key inside maps and structs.

    The recursion follows the column's type, so the plan is fixed before any
    row is read. Levels past the depth limit become a marker text.
    """
    if depth > C.LOG_DEPTH:
        return F.lit(C.TOO_DEEP)
    if isinstance(data_type, T.StringType):
        return redact_text(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda v: redact(v, data_type.elementType, depth + 1))
    if isinstance(data_type, T.MapType) and isinstance(data_type.valueType, T.StringType):
        return F.transform_values(
            value,
            lambda k, v: F.when(matches(k, C.LOG_KEY, ignore_case=True), F.lit(C.MASK)).otherwise(
                redact(v, data_type.valueType, depth + 1)
            ),
        )
    if isinstance(data_type, T.StructType):
        fields = []
        for field in data_type.fields:
            secret = any(word in field.name.lower() for word in C.LOG_KEY.split("|"))
            child = F.lit(C.MASK) if secret else redact(value[field.name], field.dataType, depth + 1)
            fields.append(child.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    return value
