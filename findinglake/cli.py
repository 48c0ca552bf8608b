"""Scan a working tree or a change from the command line.

    python -m findinglake PATH...                 # files
    python -m findinglake --diff origin/main      # changed lines only

Exit code 0: nothing at or above --fail-on; 1: something is; 2: could not run.
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
from urllib.parse import urlparse
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CONFIG_PATHS, RepoConfig, Settings, merge, parse
from .fixed_values.enums import CATEGORIES, CATEGORY_LABELS, MAX_FILE_BYTES, SEVERITIES
from .fixed_values.rules import ALL_RULES
from .functions.globs import path_in_scope
from .functions.text import is_generated_path, is_scannable, words_wrapped
from .operators.planning import blocking, override_severity
from .operators.scan import ScanOptions, files_scanned, rank_order, ranked, scan, summary
from .plans.report import sarif_documents
from .schemas import FILES
from .sources.files import collect_from_paths
from .sources.patches import changed_lines, parsed_lines, read_diff
from .sources.shared import shared_dir


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="findinglake", description="Scan source files for security findings.")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--diff", metavar="REF", help="scan only lines changed since REF")
    p.add_argument("--format", choices=("pretty", "json", "sarif"), default="pretty")
    p.add_argument("--fail-on", choices=(*SEVERITIES, "never"))
    p.add_argument("--min-severity", choices=SEVERITIES)
    p.add_argument("--config", metavar="FILE")
    p.add_argument("--no-config", action="store_true")
    p.add_argument("--include-tests", action="store_true", default=None)
    p.add_argument("--disable", action="append", default=[], metavar="RULE")
    p.add_argument("--limit", type=int, default=50, help="findings printed in the pretty format")
    p.add_argument("--quiet", action="store_true", help="print the summary line only")
    p.add_argument("--list-rules", action="store_true")
    return p.parse_args(argv)


def _repo_config(args: argparse.Namespace) -> RepoConfig:
    if args.no_config:
        return RepoConfig()
    candidates = [args.config] if args.config else [c for c in CONFIG_PATHS if os.path.exists(c)]
    if not candidates:
        return RepoConfig()
    with open(candidates[0], encoding="utf-8") as handle:
        return parse(handle.read(), candidates[0])


def _settings(args: argparse.Namespace) -> tuple[Settings, tuple[str, ...]]:
    settings, warnings = merge(Settings(), _repo_config(args))
    given = {
        "fail_on": args.fail_on, "min_severity": args.min_severity, "include_tests": args.include_tests,
        "disabled_rules": (*settings.disabled_rules, *args.disable) if args.disable else None,
    }
    from dataclasses import replace

    return replace(settings, **{k: v for k, v in given.items() if v is not None}), warnings


def changed_files(spark: SparkSession, ref: str, settings: Settings) -> DataFrame:
    """Files of a git diff with their new content and changed lines.

    git writes the diff to a file, which Spark reads in parts; this process holds none of it.
    """
    folder = urlparse(shared_dir(spark)).path
    os.makedirs(folder, exist_ok=True)
    diff = os.path.join(folder, f"diff-{uuid4().hex}.txt")
    with open(diff, "xb") as out:
        subprocess.run(
            ["git", "diff", "--no-color", "--unified=3", "--diff-filter=d", ref, "--"], stdout=out, stderr=subprocess.PIPE, check=True,
        )
    path = F.col("path")
    wanted = ~is_generated_path(path) & is_scannable(path) & path_in_scope(path, settings.include, settings.exclude)
    patches = read_diff(spark, f"file://{diff}").where(wanted).select(
        "path", changed_lines(parsed_lines(F.col("patch"))).alias("changed_lines")
    )
    # Only the files that the diff names are read.
    named = [r["path"] for r in patches.where(F.size("changed_lines") > 0).select("path").distinct().collect()]
    roots = [p for p in (os.path.join(os.getcwd(), n) for n in named) if os.path.isfile(p)]
    if not roots:
        return spark.createDataFrame([], FILES)
    files, _ = collect_from_paths(spark, roots, os.getcwd(), MAX_FILE_BYTES)
    return (
        files.drop("changed_lines")
        .join(patches.where(F.size("changed_lines") > 0), F.col("file_path") == F.col("path"))
        .drop("path")
    )


def _pretty(rows: DataFrame, limit: int) -> None:
    shown = rows.select(
        "severity", "title", "file_path", "line", "snippet", "rule_id", "category", "confidence",
        F.array_join(words_wrapped(F.col("description"), 9), "\n").alias("why"),
        F.array_join(words_wrapped(F.concat(F.lit("Fix: "), "remediation"), 9), "\n").alias("fix"),
    ).limit(limit)
    for r in shown.toLocalIterator():
        print(f"{r.severity.upper():8} {r.title}\n         {r.file_path}:{r.line}\n         {r.snippet}\n\n{r.why}\n\n{r.fix}")
        print(f"         {r.rule_id} · {CATEGORY_LABELS[r.category]} · {r.confidence} confidence\n")


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    if args.list_rules:
        for rule in ALL_RULES:
            print(f"{rule.id:48} {rule.title}")
        return 0
    try:
        settings, warnings = _settings(args)
        if spark is None:
            from .session import build_session

            spark = build_session("findinglake", os.environ.get("SPARK_MASTER", "local[*]"))
            spark.sparkContext.setLogLevel("ERROR")
        if args.diff:
            files = changed_files(spark, args.diff, settings)
        else:
            files, skipped = collect_from_paths(
                spark, [os.path.abspath(p) for p in args.paths], os.getcwd(), MAX_FILE_BYTES, settings.include,
                settings.exclude,
            )
            n_skipped = skipped.count()
            for r in skipped.orderBy("file_path").limit(5).collect():
                warnings = (*warnings, f"{r.file_path} was skipped: {r.reason}")
            if n_skipped > 5:
                warnings = (*warnings, f"and {n_skipped - 5} more files were skipped")
    except (OSError, subprocess.CalledProcessError, RuntimeError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2
    options = ScanOptions(
        disabled_rules=settings.disabled_rules, min_severity=settings.min_severity, include_tests=settings.include_tests
    )
    # Read several times below; findings are small next to the files.
    found = override_severity(scan(files, options), dict(settings.overrides)).persist()
    judged = found.withColumn("verdict", F.lit(None).cast("string"))
    failing = judged.where(blocking(settings.fail_on)).count()
    for warning in warnings:
        print(warning, file=sys.stderr)
    if args.format == "json":
        for r in ranked(found).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            print(r.j)
    elif args.format == "sarif":
        shaped = judged.withColumn("run", F.lit(1)).withColumn("ord", F.struct(*rank_order(), F.col("fingerprint")))
        for name in ("reasoning", "triage_confidence", "model"):
            shaped = shaped.withColumn(name, F.lit(None).cast("string"))
        for r in sarif_documents(shaped, ["run"], "findinglake", "0.1.0", "https://example.com/findinglake").collect():
            print(r.sarif)
    else:
        if not args.quiet:
            _pretty(ranked(found), args.limit)
            hidden = found.count() - args.limit
            if hidden > 0:
                print(f"and {hidden} more findings")
        counts = summary(found).first()
        text = ", ".join(f"{counts[s]} {s}" for s in SEVERITIES if counts[s])
        scanned = files_scanned(files, options).first()[0]
        print(f"{counts.findings} findings in {scanned} files" + (f": {text}" if text else "") + f" - {failing} at or above {settings.fail_on}")
    found.unpersist()
    return 1 if failing else 0


def main() -> None:
    assert set(CATEGORY_LABELS) == set(CATEGORIES)
    sys.exit(run(sys.argv[1:]))
