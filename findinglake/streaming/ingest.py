"""Deliveries and scan batches as streams.

A sender repeats a delivery until it is acknowledged, so each id is let through
once within a time set by a watermark; what is known of older ids is forgotten,
and a delivery that comes later than that is left out. Apart from this, events
are handled in any order: a micro-batch is routed by columns and applied as a
batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.lifecycle import History, ScanBatch
from ..sources.webhooks import parse_events

DELIVERIES = "delivery string, event string, payload string"
#: For how long after its last event the id of a delivery is remembered.
REMEMBERED = "1 hour"


def read_deliveries(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Webhook deliveries dropped as JSON lines; one without a time counts as received when it is read."""
    rows = spark.readStream.schema(f"{DELIVERIES}, received_at timestamp").option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.withColumn("received_at", F.coalesce("received_at", F.current_timestamp()))


def once(deliveries: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """Each delivery id once.

    A delivery without an id cannot be told from another and stays. The watermark lies `remembered` behind the newest
    delivery; what was received before it is late and left out, and an id is forgotten once the watermark passes it by
    as much again.
    """
    keyed = deliveries.withColumn("_id", F.coalesce("delivery", F.concat(F.lit("\0"), F.uuid())))
    return keyed.withWatermark("received_at", remembered).dropDuplicatesWithinWatermark(["_id"]).drop("_id")


def reviewable(deliveries: DataFrame) -> DataFrame:
    """The deliveries that start a review."""
    return parse_events(deliveries).where(F.col("kind") == "pull_request")


def write_reviewable(deliveries: DataFrame, out: str, checkpoint: str, remembered: str = REMEMBERED) -> StreamingQuery:
    return (
        reviewable(once(deliveries, remembered))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def record_stream(
    spark: SparkSession, folder: str, schema: StructType, history: History, checkpoint: str
) -> StreamingQuery:
    """Apply scans to the history as they arrive.

    A row is one finished scan: full_name, scanned_at, scan columns, findings
    (array), examined (array). All scans of a micro-batch are folded in one pass, those of a repository in their
    order. A scan is known by its repository, time and head: one that the
    history has already is left out, so a micro-batch that is replayed, with
    the same checkpoint or a fresh one, changes nothing.
    """

    def apply(batch: DataFrame, _epoch: int) -> None:
        order = Window.partitionBy("full_name").orderBy("scanned_at", "head_sha")
        # Persisted because its parts are read one by one; sized by one micro-batch.
        scans = unrecorded(batch, history).withColumn("scan", F.row_number().over(order).cast("long")).persist()
        try:
            at = scans.agg(F.max("scanned_at")).first()[0]
            if at is not None:
                history.record(_parted(scans), at)
        finally:
            scans.unpersist()

    return (
        spark.readStream.schema(schema)
        .json(folder)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def unrecorded(scans: DataFrame, history: History) -> DataFrame:
    """The scans, each once, that the history does not hold."""
    if "head_sha" not in scans.columns:
        scans = scans.withColumn("head_sha", F.lit(None).cast("string"))
    store = history.tables()
    known = store.scans.join(
        store.repositories.select(F.col("id").alias("repository_id"), F.col("full_name").alias("k_name")), "repository_id"
    ).select("k_name", F.col("created_at").alias("k_at"), F.col("head_sha").alias("k_sha"))
    same = (
        (F.col("full_name") == F.col("k_name"))
        & (F.col("scanned_at").cast("timestamp_ntz") == F.col("k_at"))
        & F.col("head_sha").eqNullSafe(F.col("k_sha"))
    )
    return scans.dropDuplicates(["full_name", "scanned_at", "head_sha"]).join(known, same, "left_anti")


def _parted(scans: DataFrame) -> ScanBatch:
    key = ["full_name", "scan"]
    return ScanBatch(
        scans=scans.drop("findings", "examined"),
        findings=scans.select(*key, F.posexplode("findings").alias("seq", "f")).select(*key, "seq", "f.*"),
        examined=scans.select(*key, F.explode("examined").alias("e")).select(*key, "e.path", "e.lines"),
    )
