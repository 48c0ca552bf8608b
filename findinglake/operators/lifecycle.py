"""Open / resolved lifecycle of findings across scans.

Everything is keyed joins on (repository_id, fingerprint) and (repository_id,
path, line). `apply_scan` takes at most one scan per repository; `finding_spans`
and what follows it fold any number of scans of each repository in one pass.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import FINDING_STATE, OBSERVATIONS, REPOSITORIES, SCANS, conform

KEY = ["repository_id", "fingerprint"]
_ID_BUCKETS = 256


def open_fingerprints(state: DataFrame) -> DataFrame:
    return state.where(F.col("status") == "open").select(*KEY)


def new_findings(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows whose fingerprint was not open before; repeats stay repeats."""
    return batch.join(open_fingerprints(state), KEY, "left_anti")


def label_new(findings: DataFrame, state: DataFrame) -> DataFrame:
    """Flag each finding as introduced now or already open."""
    known = open_fingerprints(state).withColumn("known", F.lit(True))
    return findings.join(known, KEY, "left").withColumn("is_new", F.col("known").isNull()).drop("known")


#: Stands for every line of a file.
_WHOLE = -1


def scope(batch: DataFrame, examined: DataFrame) -> DataFrame:
    """Locations a scan looked at: (repository_id, file_path, line), the line _WHOLE for whole files.

    A null line array stands for the whole file. A reported finding proves its
    own line was looked at.
    """
    looked = F.coalesce("lines", F.array(F.lit(_WHOLE)))
    return (
        examined.select("repository_id", F.col("path").alias("file_path"), F.explode(looked).alias("line"))
        .unionByName(batch.select("repository_id", "file_path", "line"))
        .distinct()
    )


def resolved_findings(state: DataFrame, batch: DataFrame, examined: DataFrame) -> DataFrame:
    """Open rows the scan looked at and did not report again."""
    gone = (
        state.where(F.col("status") == "open")
        .select(*KEY, "file_path", "line")
        .join(batch.select(*KEY), KEY, "left_anti")
    )
    # Each row asks for its file as a whole and for its line; a row that finds both is one row still.
    asked = gone.select(*KEY, "file_path", F.col("line").alias("own_line"), F.explode(F.array(F.lit(_WHOLE), "line")).alias("line"))
    found = asked.join(scope(batch, examined), ["repository_id", "file_path", "line"], "left_semi")
    return found.select(*KEY, "file_path", F.col("own_line").alias("line")).distinct()


def _fold_batch(batch: DataFrame) -> DataFrame:
    """One row per key. Identity comes from its first sighting, the moving
    columns from its last, the verdict from its last non-null one."""
    judged = F.when(F.col("verdict").isNotNull(), F.col("seq"))
    return batch.groupBy(*KEY).agg(
        F.min_by(F.struct("rule_id", "category"), F.col("seq")).alias("b_identity"),
        F.max_by(F.struct("severity", "file_path", "line", "title"), F.col("seq")).alias("b_latest"),
        F.max_by(F.col("verdict"), judged).alias("b_verdict"),
    )


def apply_scan(
    state: DataFrame, batch: DataFrame, examined: DataFrame, as_of: Column, times: DataFrame | None = None
) -> DataFrame:
    """The state table after one batch.

    Seen keys are (re)opened and refreshed; examined-but-absent keys close;
    the rest is untouched. New keys start at the time of their repository's
    scan, which `times` (repository_id, scanned_at) tells, else at `as_of`; a
    reopened key keeps its first_seen_at.
    """
    seen = _fold_batch(batch)
    closed = resolved_findings(state, batch, examined).select(*KEY, F.lit(True).alias("b_closed"))
    delta = seen.withColumn("b_closed", F.lit(False)).unionByName(closed, allowMissingColumns=True)
    at = F.lit(None).cast("timestamp_ntz")
    if times is None:
        delta = delta.withColumn("b_at", at)
    else:
        own = times.select("repository_id", F.col("scanned_at").cast("timestamp_ntz").alias("b_at"))
        delta = delta.join(own, "repository_id", "left")
    old = state.withColumn("s_known", F.lit(True))
    both = old.join(delta, KEY, "full_outer")
    was_seen = F.col("b_identity").isNotNull()
    was_closed = F.coalesce(F.col("b_closed"), F.lit(False))
    fresh = F.col("s_known").isNull()

    def refreshed(name: str) -> Column:
        return F.when(was_seen, F.col(f"b_latest.{name}")).otherwise(F.col(name)).alias(name)

    now = F.coalesce(F.col("b_at"), as_of.cast("timestamp_ntz"))
    return both.select(
        *KEY,
        F.when(fresh, F.col("b_identity.rule_id")).otherwise(F.col("rule_id")).alias("rule_id"),
        F.when(fresh, F.col("b_identity.category")).otherwise(F.col("category")).alias("category"),
        refreshed("severity"),
        refreshed("file_path"),
        refreshed("line"),
        refreshed("title"),
        F.when(was_seen, "open").when(was_closed, "resolved").otherwise(F.col("status")).alias("status"),
        F.coalesce("b_verdict", "verdict").alias("verdict"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(was_seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(was_seen, F.lit(None)).when(was_closed, now).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )


def scan_counts(state: DataFrame, batch: DataFrame, examined: DataFrame) -> DataFrame:
    """Per repository: findings reported, new ones, resolved ones."""
    open_keys = open_fingerprints(state).withColumn("was_open", F.lit(True))
    reported = (
        batch.join(open_keys, KEY, "left")
        .groupBy("repository_id")
        .agg(
            F.count("*").alias("findings_count"),
            F.count_if(F.col("was_open").isNull()).alias("new_findings_count"),
        )
    )
    closed = (
        resolved_findings(state, batch, examined)
        .groupBy("repository_id")
        .agg(F.count("*").alias("resolved_findings_count"))
    )
    return reported.join(closed, "repository_id", "full_outer").na.fill(
        0, ["findings_count", "new_findings_count", "resolved_findings_count"]
    )


def dense_ids(names: DataFrame, column: str, start: Column) -> DataFrame:
    """Consecutive ids without sorting all names in one task.

    Names are numbered inside hash buckets; a bucket's offset is the size of
    the buckets before it. Both parts depend on the data only, so a recomputed
    task hands out the same ids.
    """
    bucketed = names.select(column).distinct().withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(_ID_BUCKETS)))
    within = Window.partitionBy("bucket").orderBy(column)
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    return (
        bucketed.withColumn("rn", F.row_number().over(within))
        .join(offsets, "bucket")
        .select(column, (start + F.col("offset") + F.col("rn")).cast("long").alias("id"))
    )


def with_new_repositories(repositories: DataFrame, names: DataFrame, as_of: Column) -> DataFrame:
    """Existing repositories plus an id for every name not seen before, made at its scanned_at if `names` has one."""
    unseen = names.select("full_name").join(repositories.select("full_name"), "full_name", "left_anti")
    top = repositories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    created = dense_ids(unseen, "full_name", top.scalar())
    if "scanned_at" in names.columns:
        first = names.groupBy("full_name").agg(F.min("scanned_at").cast("timestamp_ntz").alias("created_at"))
        created = created.join(first, "full_name")
    else:
        created = created.withColumn("created_at", as_of.cast("timestamp_ntz"))
    return repositories.unionByName(created.select("id", "full_name", "created_at"))


#: Where a finding that was open before the first scan of a batch stands in the order of scans.
_BEFORE = -1


def fold_sightings(findings: DataFrame, times: DataFrame) -> DataFrame:
    """One row per key and scan: how often and where it was reported, its first identity, last columns and last verdict.

    `findings` are a batch's with `scan`, the place of their scan among those of the repository (0 or more); `times`
    has (repository_id, scan, scanned_at).
    """
    judged = F.when(F.col("verdict").isNotNull(), F.col("seq"))
    folded = findings.groupBy(*KEY, "scan").agg(
        F.count("*").alias("n"),
        F.collect_set(F.struct("file_path", "line")).alias("places"),
        F.min_by(F.struct("rule_id", "category"), F.col("seq")).alias("identity"),
        F.max_by(F.struct("severity", "file_path", "line", "title"), F.col("seq")).alias("latest"),
        F.max_by(F.col("verdict"), judged).alias("verdict"),
    )
    return folded.join(times.select("repository_id", "scan", F.col("scanned_at").cast("timestamp_ntz").alias("at")), ["repository_id", "scan"])


def finding_spans(state: DataFrame, sightings: DataFrame, examined: DataFrame, times: DataFrame) -> DataFrame:
    """Stretches between a key's sightings, each with the scan that closes it, if one does.

    A stretch begins with a sighting, or with a row that is open before the batch, and ends with the next sighting. It
    is closed by the first scan in between that looked at where the finding then was. Scans that looked at a place are
    found once for each place and beginning, so a file with many findings is asked about as often as it was scanned.
    """
    begun = state.where(F.col("status") == "open").join(times.select("repository_id").distinct(), "repository_id", "left_semi").select(
        *KEY, F.lit(_BEFORE).cast("long").alias("scan"), F.struct("severity", "file_path", "line", "title").alias("latest")
    )
    by_key = Window.partitionBy(*KEY).orderBy("scan")
    spans = sightings.drop("places").unionByName(begun, allowMissingColumns=True).select(
        "*",
        F.lead("scan").over(by_key).alias("next_scan"), F.lead("n").over(by_key).alias("next_n"),
        F.lag("scan").over(by_key).isNull().alias("leads"),
    )
    place = ["repository_id", "file_path", "line"]
    looked = (
        examined.select(
            "repository_id", "scan", F.col("path").alias("file_path"), F.explode(F.coalesce("lines", F.array(F.lit(_WHOLE)))).alias("line")
        )
        .unionByName(sightings.select("repository_id", "scan", F.inline("places")))
        .distinct()
        .join(times.select("repository_id", "scan", F.col("scanned_at").cast("timestamp_ntz").alias("at")), ["repository_id", "scan"])
    )
    asked = spans.select("*", F.explode(F.array(F.lit(_WHOLE), F.col("latest.line"))).alias("asked_line"))
    asked = asked.withColumns({"file_path": F.col("latest.file_path"), "line": F.col("asked_line")})
    later = Window.partitionBy(*place).orderBy("scan").rangeBetween(1, Window.unboundedFollowing)
    beginnings = asked.select(*place, "scan").distinct()
    found = (
        looked.select(*place, "scan", F.struct("scan", "at").alias("seen"), F.lit(False).alias("asks"))
        .unionByName(beginnings.select(*place, "scan", F.lit(True).alias("asks")), allowMissingColumns=True)
        .select(*place, "scan", "asks", F.min("seen").over(later).alias("closes"))
        .where("asks and closes is not null")
        .drop("asks")
    )
    met = asked.join(found, [*place, "scan"], "left")
    inside = F.col("closes.scan") < F.coalesce("next_scan", F.lit((1 << 62)))
    # A stretch asks for its file as a whole and for its line; the earlier answer closes it.
    return met.groupBy(*KEY, "scan").agg(
        *(F.first(c).alias(c) for c in ("at", "n", "identity", "latest", "verdict", "next_scan", "next_n", "leads")),
        F.min(F.when(inside, F.col("closes"))).alias("closes"),
    )


def fold_state(state: DataFrame, spans: DataFrame) -> DataFrame:
    """The state table after all scans of `spans`; rows that none of them touches stay as they are."""
    sighted = F.col("n").isNotNull()
    order = F.when(sighted, F.col("scan"))
    delta = spans.groupBy(*KEY).agg(
        F.min_by("identity", order).alias("b_identity"), F.max_by("latest", order).alias("b_latest"),
        F.max_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("scan"))).alias("b_verdict"),
        F.min_by("at", order).alias("b_first"), F.max_by("at", order).alias("b_last"),
        F.max_by("closes.at", "scan").alias("b_closed"),
    )
    both = state.withColumn("s_known", F.lit(True)).join(delta, KEY, "full_outer")
    was_seen, was_closed = F.col("b_identity").isNotNull(), F.col("b_closed").isNotNull()
    fresh = F.col("s_known").isNull()

    def refreshed(name: str) -> Column:
        return F.when(was_seen, F.col(f"b_latest.{name}")).otherwise(F.col(name)).alias(name)

    return both.select(
        *KEY,
        *(F.when(fresh, F.col(f"b_identity.{c}")).otherwise(F.col(c)).alias(c) for c in ("rule_id", "category")),
        *(refreshed(c) for c in ("severity", "file_path", "line", "title")),
        F.when(was_closed, "resolved").when(was_seen, "open").otherwise(F.col("status")).alias("status"),
        F.coalesce("b_verdict", "verdict").alias("verdict"),
        F.coalesce("first_seen_at", "b_first").alias("first_seen_at"),
        F.coalesce("b_last", "last_seen_at").alias("last_seen_at"),
        F.when(was_closed, F.col("b_closed")).when(~was_seen, F.col("resolved_at")).alias("resolved_at"),
    )


def fold_counts(spans: DataFrame) -> DataFrame:
    """Per repository and scan: findings reported, those that were not open before it, those that it resolved."""
    none = F.lit(0).cast("long")

    def part(scan: Column, reported: Column, new: Column, resolved: Column) -> Column:
        return F.when(
            scan.isNotNull() & (scan != _BEFORE),
            F.struct(scan.alias("scan"), reported.alias("reported"), new.alias("new"), resolved.alias("resolved")),
        )

    n, closed = F.col("n"), F.col("closes").isNotNull()
    parts = F.array_compact(F.array(
        part(F.col("scan"), n, F.when(F.col("leads"), n).otherwise(none), none),
        part(F.when(closed, F.col("next_scan")), none, F.col("next_n"), none),
        part(F.col("closes.scan"), none, none, F.lit(1).cast("long")),
    ))
    return spans.select("repository_id", F.inline(parts)).groupBy("repository_id", "scan").agg(
        F.sum("reported").alias("findings_count"), F.sum("new").alias("new_findings_count"), F.sum("resolved").alias("resolved_findings_count")
    )


@dataclass(frozen=True)
class ScanBatch:
    """Finished scans, keyed by repository name.

    scans: full_name, pull_request_number, head_sha, base_sha, title, author,
    files_scanned, duration_ms, and scanned_at unless all ran at one time. findings: full_name, seq, finding columns and
    optional verdict columns. examined: full_name, path, lines. If a repository has several scans, all three have `scan`,
    its place among them (0 or more).
    """

    scans: DataFrame
    findings: DataFrame
    examined: DataFrame


class TakenError(RuntimeError):
    """Another writer committed the version first; nothing of this batch is recorded."""


class History:
    """History of parquet tables that only grows by whole batches.

    A batch writes into a folder of its own: new repositories, its scans, its findings, and the state of the buckets
    that its repositories lie in (a bucket is a fixed hash of repository_id). Then one small file, named by the version
    and made only if no file of that name exists, makes the folder part of the history. A reader takes the state of a
    bucket from the last version that touched it. So a batch that fails or comes second changes nothing that others can
    see, buckets without its repositories keep their files, and a retried task only writes into the batch's own folder.

    The exclusive creation is the file system's: a link on local disks, `create` without overwrite elsewhere, which
    HDFS makes atomic.
    """

    BUCKETS = 64
    _COMMIT = "version long, folder string, buckets array<int>, of int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _commits(self) -> list[Row]:
        """The commits, oldest first: one small row for each batch ever recorded."""
        try:
            return self.spark.read.schema(self._COMMIT).json(f"{self.root}/commits").orderBy("version").collect()
        except AnalysisException as error:  # the folder does not exist before the first commit
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def version(self) -> int:
        return max((c.version for c in self._commits()), default=0)

    def _read(self, paths: list[str], schema) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return conform(self.spark.read.parquet(*paths), schema)

    def _state(self, commits: list[Row], buckets: set[int] | None = None) -> DataFrame:
        last = {bucket: c.folder for c in commits for bucket in c.buckets}
        paths = [f"{self.root}/data/{folder}/finding_state/bucket={b}" for b, folder in sorted(last.items()) if buckets is None or b in buckets]
        return self._read(paths, FINDING_STATE)

    def tables(self, version: int | None = None):
        """Store over the newest (or a given) committed version."""
        from ..sources.tables import Store

        commits = [c for c in self._commits() if version is None or c.version <= version]
        logs = {name: [f"{self.root}/data/{c.folder}/{name}" for c in commits] for name in ("repositories", "scans", "findings")}
        return Store(
            repositories=self._read(logs["repositories"], REPOSITORIES),
            scans=self._read(logs["scans"], SCANS),
            finding_state=self._state(commits),
            findings=self._read(logs["findings"], OBSERVATIONS),
        )

    def days(self) -> DataFrame:
        """The table of days that trends read: what all batches changed, added up."""
        from ..plans.rollups import DAYS, merged

        paths = [f"{self.root}/data/{c.folder}/days" for c in self._commits()]
        return merged(self.spark.read.schema(DAYS).parquet(*paths) if paths else self.spark.createDataFrame([], DAYS))

    def _commit(self, version: int, folder: str, buckets: list[int]) -> None:
        text = json.dumps({"version": version, "folder": folder, "buckets": buckets, "of": self.BUCKETS})
        path = f"{self.root}/commits/{version:020d}.json"
        if not create_exclusively(self.spark, path, text):
            raise TakenError(f"another writer committed version {version} meanwhile; this batch is not recorded")

    def record(self, batch: ScanBatch, as_of: datetime) -> int:
        """Apply one batch, scans of a repository in their order, and commit it; returns the new version."""
        from ..plans.rollups import day_changes

        before = self.version()
        commits = [c for c in self._commits() if c.version <= before]
        if any(c.of != self.BUCKETS for c in commits):
            raise ValueError(f"this history has {commits[0].of} buckets, not {self.BUCKETS}")
        store = self.tables(before)
        now = F.lit(as_of).cast("timestamp_ntz")
        folder = uuid4().hex

        def write(df: DataFrame, name: str, schema, *by: str) -> DataFrame:
            path = f"{self.root}/data/{folder}/{name}"
            df.write.partitionBy(*by).parquet(path)
            return self.spark.read.schema(df.schema if schema is None else schema).parquet(path)

        timed = "scanned_at" in batch.scans.columns
        several = "scan" in batch.scans.columns
        scans, findings, examined = batch.scans, batch.findings, batch.examined
        if not several:
            scans, findings, examined = (df.withColumn("scan", F.lit(0)) for df in (scans, findings, examined))
        scans = scans.withColumn("scan", F.col("scan").cast("long")).withColumn(
            "scanned_at", F.coalesce(F.col("scanned_at").cast("timestamp_ntz"), now) if timed else now
        )
        grown = with_new_repositories(store.repositories, scans.select("full_name", "scanned_at"), now)
        fresh = write(conform(grown.join(store.repositories.select("id"), "id", "left_anti"), REPOSITORIES), "repositories", REPOSITORIES)
        ids = store.repositories.unionByName(fresh).select(F.col("id").alias("repository_id"), "full_name")
        runs = scans.join(ids, "full_name")
        bucket = F.pmod(F.xxhash64("repository_id"), F.lit(self.BUCKETS)).cast("int")
        buckets = sorted(r[0] for r in runs.select(bucket.alias("b")).distinct().collect())

        findings = findings.join(ids, "full_name").withColumn("scan", F.col("scan").cast("long"))
        for optional in ("verdict", "triage_confidence", "triage_model"):
            if optional not in findings.columns:
                findings = findings.withColumn(optional, F.lit(None).cast("string"))
        examined = examined.join(ids, "full_name").withColumn("scan", F.col("scan").cast("long"))
        old = self._state(commits, set(buckets))
        spans = write(finding_spans(old, fold_sightings(findings, runs), examined, runs), "spans", None)

        name = F.concat_ws("\0", "full_name", F.lpad(F.col("scan").cast("string"), 20, "0"))
        runs = runs.withColumn("scan_name", name)
        top = store.scans.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        counted = ["findings_count", "new_findings_count", "resolved_findings_count"]
        numbered = (
            runs.join(dense_ids(runs, "scan_name", top.scalar()), "scan_name")
            .join(fold_counts(spans), ["repository_id", "scan"], "left")
            .na.fill(0, counted)
            .withColumn("created_at", F.col("scanned_at"))
        )
        numbered = write(numbered, "scans", None)
        own = numbered.select(F.col("id").alias("scan_id"), "repository_id", "scan", "created_at")
        write(conform(findings.drop("created_at").join(own, ["repository_id", "scan"]), OBSERVATIONS), "findings", OBSERVATIONS)
        after = conform(fold_state(old, spans), FINDING_STATE).withColumn("bucket", bucket)
        # Rebalancing deals out what the state of a large bucket needs to several files.
        after = write(after.hint("rebalance", "bucket"), "finding_state", None, "bucket")
        write(day_changes(old, after), "days", None)
        # A repository without findings leaves its bucket as it is, maybe without a file.
        buckets = sorted(r[0] for r in after.select("bucket").distinct().collect())
        if self.version() != before:
            raise TakenError(f"another writer committed version {before + 1} meanwhile; this batch is not recorded")
        self._commit(before + 1, folder, buckets)
        return before + 1


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with its whole text unless there is one; false if there is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getScheme() == "file":
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = os.path.join(os.path.dirname(local), f".{uuid4().hex}")
        with open(part, "x", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(part, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    try:
        stream = system.create(where, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
