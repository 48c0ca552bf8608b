"""The history tables, and how they are read off the given star schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values.enums import CATEGORIES

PART_CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@dataclass(frozen=True)
class Store:
    """The four history tables plus the category values they use."""

    repositories: DataFrame
    scans: DataFrame
    finding_state: DataFrame
    findings: DataFrame | None = None
    categories: tuple[str, ...] = CATEGORIES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A number of partitions that the caller asks for where rows are worked on one by one.
SPREAD = "spark.findinglake.partitions"


#: Partitions without such a number: so many for a core, and no fewer in all.
PER_CORE, LEAST = 4, 32


def dealt(df: DataFrame) -> int:
    """Partitions to deal rows out to: what is asked for, or a few for each core, or as many as shuffles have."""
    spark = df.sparkSession
    wanted = spark.conf.get(SPREAD, None)
    return int(wanted or max(LEAST, PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out over the cluster: one shuffle of these columns.

    A file of few, large row groups is one task each otherwise, however many cores there are. A task of a scan costs
    about half a second before its first row, so without a number asked for there are a few for each core, or as many
    as the input has.
    """
    spark = df.sparkSession
    wanted = spark.conf.get(SPREAD, None)
    if not wanted:
        wanted = max(LEAST, PER_CORE * spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(int(wanted))


def hashed(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(" ", *parts), 256), 1, 20)


def fingerprint(rule: Column, path: Column) -> Column:
    return hashed(rule, path)


#: What a fingerprint is made of. Grouping by these and hashing the groups costs one hash a group, not one a sighting.
IDENTITY = ["repository_id", "rule_id", "file_path"]


def severity_of_priority(priority: Column) -> Column:
    first = F.substring(priority, 1, 1)
    return (
        F.when(first == "1", "critical")
        .when(first == "2", "high")
        .when(first == "3", "medium")
        .when(first == "4", "low")
        .otherwise("info")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem is one sighting of a finding, in one repository."""
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    rule = F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand"))
    path = F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string"))
    return (
        line.join(placed, line.l_orderkey == placed.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .select(
            F.col("c_nationkey").cast("long").alias("repository_id"),
            rule.alias("rule_id"),
            F.col("p_type").alias("category"),
            severity_of_priority(F.col("o_orderpriority")).alias("severity"),
            path.alias("file_path"),
            F.col("l_linenumber").alias("line"),
            fingerprint(rule, path).alias("fingerprint"),
            F.col("o_orderdate").alias("observed_at"),
            F.col("l_shipdate").alias("shipdate"),
            F.col("l_linestatus").alias("st"),
            F.col("l_returnflag").alias("rf"),
            F.col("o_orderkey").alias("okey"),
            F.col("l_partkey").alias("pkey"),
            F.col("l_suppkey").alias("skey"),
            F.col("l_extendedprice").alias("price"),
        )
    )


def finding_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest sighting per (repository, fingerprint) by partial aggregation.

    `max_by` keeps one row per key on the map side, so a fingerprint seen in a
    third of all sightings costs its reducer one row per map task.
    """
    recency = F.struct("observed_at", "okey", "line", "pkey", "skey", "price")
    payload = F.struct("category", "severity", "line", "st", "rf", "shipdate")
    latest = (
        observations(spark, sf_dir)
        .groupBy(*IDENTITY)
        .agg(
            F.max_by(payload, recency).alias("v"),
            F.min("observed_at").alias("first_seen_at"),
            F.max("observed_at").alias("last_seen_at"),
        )
    )
    return latest.select(
        "repository_id",
        fingerprint(F.col("rule_id"), F.col("file_path")).alias("fingerprint"),
        "rule_id",
        "v.category",
        "v.severity",
        "file_path",
        "v.line",
        F.col("rule_id").alias("title"),
        F.when(F.col("v.st") == "O", "open").otherwise("resolved").alias("status"),
        F.when(F.col("v.rf") == "A", "confirmed").when(F.col("v.rf") == "R", "refuted").alias("verdict"),
        "first_seen_at",
        "last_seen_at",
        F.when(F.col("v.st") == "F", F.greatest("last_seen_at", "v.shipdate")).alias("resolved_at"),
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("full_name")
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review run per order; counters are arithmetic on its keys."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    key = F.col("o_orderkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        key.alias("id"),
        F.col("c_nationkey").cast("long").alias("repository_id"),
        F.col("o_custkey").alias("pull_request_number"),
        F.substring(F.sha2(key.cast("string"), 256), 1, 12).alias("head_sha"),
        F.concat(F.lit("review "), "o_orderstatus").alias("title"),
        F.col("c_name").alias("author"),
        (F.col("o_custkey") % 30).alias("files_scanned"),
        (key % 40).alias("findings_count"),
        (key % 7).alias("new_findings_count"),
        (key % 5).alias("resolved_findings_count"),
        (key % 9000).alias("duration_ms"),
        F.col("o_orderdate").alias("created_at"),
    )


def star_store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(
        repositories=repositories(spark, sf_dir),
        scans=scans(spark, sf_dir),
        finding_state=finding_state(spark, sf_dir),
        categories=PART_CATEGORIES,
    )
