"""Helpers shared by the operators: reading, row identity, shared scratch space, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of text that a Python task turns into output before it hands a batch on.
BATCH_CHARS = 2_000_000
#: Rows of an Arrow batch that become Python values at a time.
SLICE_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; one set here only in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="findinglake-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: While a table is stored: its shuffle files go once it is written, wide rows travel and are read in small batches, and
#: files are read without the direct buffers of a whole row group.
_WHILE_STORED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "parquet.hadoop.vectored.io.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/findinglake-llm/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, _WHILE_STORED):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """`stored`, laid out by a hash of `key`: joins on it bring the other side to these rows and move none of them."""
    spark = df.sparkSession
    table = f"findinglake_{name}_{uuid.uuid4().hex}"
    with settings(spark, _WHILE_STORED):
        writer = df.write.format("parquet").option("path", f"{_own_folder(spark)}/{table}")
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    return spark.table(table)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `stored` wrote and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if f"/findinglake-llm/{spark.sparkContext.applicationId}/" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """With the id, tells rows apart whose ids repeat; rows equal in both have equal results."""
    return F.xxhash64(text)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_rows(
    df: DataFrame,
    columns: list[Column],
    row: Callable[..., tuple],
    schema: str,
    arrow_schema: pa.Schema,
    text_at: int = -1,
) -> DataFrame:
    """Apply `row` to each row's columns in Arrow batches; one result row for each, in bounded batches.

    The columns are renamed by position before they leave the JVM, so clashing names in `df` do not matter. A `schema`
    that begins with `row_id` alone gives it the type of the first column; `arrow_schema` then has the others.
    """
    narrow = df.select([c.alias(f"c{k}") for k, c in enumerate(columns)])
    if schema.startswith("row_id,"):
        kind = narrow.schema["c0"].dataType
        schema = f"row_id {kind.simpleString()}{schema[6:]}"
        arrow_schema = pa.schema([pa.field("row_id", to_arrow_type(kind)), *arrow_schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars = [], 0
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for values in zip(*(c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns)):
                    held.append(row(*values))
                    chars += len(values[text_at] or "")
                    if chars >= BATCH_CHARS:
                        yield as_batch(held, arrow_schema)
                        held, chars = [], 0
            if held:
                yield as_batch(held, arrow_schema)

    return narrow.mapInArrow(run, schema)


def sliced(column: pa.Array) -> Iterator[list]:
    """A column's values, a slice at a time."""
    for start in range(0, len(column), SLICE_ROWS):
        yield column.slice(start, SLICE_ROWS).to_pylist()


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema
    )
