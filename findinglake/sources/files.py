"""Working-tree files as a table."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values.enums import MAX_FILE_BYTES
from ..functions.globs import path_in_scope
from ..functions.text import in_skipped_directory, is_generated_path, is_scannable

_SNIFFED_BYTES = 1024


def outermost(roots: Sequence[str]) -> list[str]:
    """The roots without those that lie under another, so no file is reached twice."""
    plain = sorted({posixpath.normpath(r) for r in roots})
    return [r for r in plain if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in plain)]


def _listed(spark: SparkSession, roots: Sequence[str], base: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(outermost(roots))
    plain = F.regexp_replace("path", "^file:(//)?", "")
    prefix = base.rstrip("/") + "/"
    shown = F.when(plain.startswith(prefix), plain.substr(F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)
    return found.select(shown.alias("file_path"), "length", "content")


def collect_from_paths(
    spark: SparkSession,
    roots: Sequence[str],
    base: str,
    max_bytes: int = MAX_FILE_BYTES,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) under the roots.

    Paths decide before bytes are read; oversized files are reported, binary
    ones (a NUL near the start) are dropped, and a path reached through two
    roots counts once. No content is shuffled.
    """
    path = F.col("file_path")
    listed = _listed(spark, roots, base).where(
        ~in_skipped_directory(path) & ~is_generated_path(path) & is_scannable(path)
        & path_in_scope(path, include, exclude)
    )
    skipped = listed.where(F.col("length") > max_bytes).select(
        "file_path", F.lit(f"larger than {max_bytes} bytes").alias("reason")
    )
    head = F.substring("content", 1, _SNIFFED_BYTES)
    text = listed.where((F.col("length") <= max_bytes) & ~F.hex(head).rlike("^(?:..)*?00"))
    files = text.select(
        F.xxhash64("file_path").alias("file_idx"),
        "file_path",
        F.decode("content", "UTF-8").alias("content"),
        F.lit("modified").alias("status"),
        F.lit(None).cast("array<int>").alias("changed_lines"),
    )
    return files, skipped
