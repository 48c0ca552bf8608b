"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: ASCII letters lower-cased, lines that
open with a copyright statement left out, runs of punctuation and white space
made one space, equivalent spellings made one. The SHA-256 of the form is
looked up among the digests of known licence texts and notices, which go
through the same expressions. Looked up are the entire text and each entire
line of it, as a notice stands in a line of its own; no part of a line is
ever compared.

Cases: a null or empty text matches nothing, and empty lines are not looked up;
ids in any state are carried along; repeated rows give repeated rows; a text
known under several ids reports the one that sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_key
from .license_texts import KNOWN, SPELLINGS

COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form with line breaks kept: lower case, marks as spaces, one spelling."""
    plain = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    form = F.regexp_replace(plain, MARKS, " ")
    # A space on either side of each line, so that words at its ends are whole words too.
    form = F.concat(F.lit(" "), F.replace(form, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for spelling, kept in SPELLINGS:
        form = F.replace(form, F.lit(spelling), F.lit(kept))
    return F.split(form, "\n")


def trimmed_lines(text: Column) -> Column:
    return F.transform(canonical_lines(text), lambda line: F.trim(F.regexp_replace(line, " +", " ")))


def units(lines: Column) -> Column:
    """(at, digest): the entire text at 0, and its lines from 1; null where a unit is empty."""
    whole = F.trim(F.regexp_replace(F.array_join(lines, " "), " +", " "))
    return F.transform(F.concat(F.array(whole), lines), lambda form, at: F.struct(
        at.alias("at"), F.when(form != "", F.sha2(form, 256)).alias("digest")
    ))


def known_digests(like: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, license) of the known texts; a fixed list."""
    texts = like.sparkSession.createDataFrame(list(known), "license string, known string")
    lines = texts.select("license", trimmed_lines(F.col("known")).alias("lines"))
    return lines.select("license", F.inline(units(F.col("lines")))).where("at = 0").groupBy("digest").agg(F.min("license").alias("license"))


def scan(
    df: DataFrame, text: str = "text", row_id: str = "doc_id", known: tuple[tuple[str, str], ...] = KNOWN
) -> DataFrame:
    """One row per input row: the id, `license` of the entire text (or null), `notices`: (line, license) by line."""
    key = [F.col(row_id).alias("_id"), text_key(F.col(text)).alias("_key")]
    # The lines are a column of their own first: used twice below, they are still worked out once.
    lines = df.select(*key, trimmed_lines(F.col(text)).alias("_lines"))
    each = lines.select("_id", "_key", F.inline(units(F.col("_lines"))))
    met = each.join(F.broadcast(known_digests(df, known)), "digest")
    found = met.groupBy("_id", "_key").agg(
        F.min(F.when(F.col("at") == 0, F.col("license"))).alias("license"),
        F.array_sort(F.array_compact(F.collect_set(F.when(F.col("at") > 0, F.struct(F.col("at").alias("line"), "license"))))).alias("notices"),
    )
    rows = df.select(*key)
    same = rows["_id"].eqNullSafe(found["_id"]) & (rows["_key"] == found["_key"])
    return rows.join(found, same, "left").select(
        rows["_id"].alias(row_id), "license",
        F.coalesce("notices", F.array().cast("array<struct<line:int,license:string>>")).alias("notices"),
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    form = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = f"regexp_replace({form}, {_sql_text(COPYRIGHT_LINE)}, '\\1', 'g')"
    form = f"regexp_replace({form}, {_sql_text(MARKS)}, ' ', 'g')"
    form = f"' ' || replace({form}, chr(10), ' ' || chr(10) || ' ') || ' '"
    for spelling, kept in SPELLINGS:
        form = f"replace({form}, {_sql_text(spelling)}, {_sql_text(kept)})"
    return f"list_transform(string_split({form}, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g')))"


def oracle() -> str:
    """DuckDB SQL for the registered query."""
    known = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in KNOWN)
    whole = "trim(regexp_replace(array_to_string(lines, ' '), ' +', ' ', 'g'))"
    return f"""
        WITH known AS (
            SELECT sha256({whole}) AS digest, min(name) AS license
            FROM (SELECT name, {_sql_lines("t")} AS lines FROM (VALUES {known}) v(name, t)) GROUP BY 1
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, {_sql_lines("text")} AS lines FROM documents
        ), entire AS (
            SELECT r, doc_id, license FROM (SELECT r, doc_id, {whole} AS form FROM d) f
            LEFT JOIN known ON form <> '' AND sha256(form) = digest
        ), line AS (
            SELECT r, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
            FROM (SELECT r, unnest(lines) AS form FROM d) JOIN known ON form <> '' AND sha256(form) = digest
            GROUP BY r
        )
        SELECT doc_id, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
        FROM entire LEFT JOIN line USING (r)"""
