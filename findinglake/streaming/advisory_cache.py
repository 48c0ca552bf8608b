"""Answers of the advisory source as keyed state with a time to live.

Questions and answers are one stream. A question is a package and a version; the
answer to it is kept in the state of that key for as long as the cache says and
is then forgotten by the state store. A question that meets a kept answer comes
out with it; one that does not comes out as pending, to be asked outside, and the
answer to it comes back in as a row of the stream. An empty list of advisories is
an answer too. Answers of a micro-batch are taken before its questions.

The session needs `SETTINGS`: Spark keeps this kind of state in its RocksDB store,
and a query that keeps time runs empty batches for ever unless told not to, so
that one which is to end would not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..fixed_values.enums import ADVISORY_CACHE_HOURS
from ..sources.advisories import KEY

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: A row of the stream: `advisories` (JSON) is null in a question.
MESSAGES = "ecosystem string, name string, version string, advisories string"
ANSWERED = "ecosystem string, key_name string, version string, name string, status string, advisories string"


class _Kept(StatefulProcessor):
    """The newest answer to one question."""

    def __init__(self, milliseconds: int):
        self._milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._answer = handle.getValueState("answer", "advisories string", self._milliseconds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, name, newest = False, None, None
        for frame in rows:
            answers = frame["advisories"].dropna()
            newest = answers.iloc[-1] if len(answers) else newest
            names = frame.loc[frame["advisories"].isna(), "name"]
            if len(names):
                asked, name = True, names.min() if name is None else min(name, names.min())
        if newest is not None:
            self._answer.update((newest,))
        if asked:
            held = self._answer.get() if self._answer.exists() else None
            yield pd.DataFrame({
                "ecosystem": [key[0]], "key_name": [key[1]], "version": [key[2]], "name": [name],
                "status": ["pending" if held is None else "answered"], "advisories": [None if held is None else held[0]],
            })

    def close(self) -> None:
        pass


def served(messages: DataFrame, hours: float = ADVISORY_CACHE_HOURS) -> DataFrame:
    """One row for each question of a micro-batch: `answered` with its advisories, or `pending`."""
    usable = messages.where((F.col("name") != "") & (F.col("version") != "") & F.col("ecosystem").isNotNull())
    return (
        usable.withColumn("key_name", F.lower("name"))
        .groupBy(*KEY)
        .transformWithStateInPandas(
            statefulProcessor=_Kept(int(hours * 3_600_000)), outputStructType=ANSWERED, outputMode="Update", timeMode="ProcessingTime"
        )
    )


def as_messages(rows: DataFrame, advisories: Column | None = None) -> DataFrame:
    """Questions (ecosystem, name, version), or answers if their advisories are given, as rows of the stream."""
    found = F.lit(None).cast("string") if advisories is None else F.to_json(F.coalesce(advisories, F.array()))
    return rows.select("ecosystem", "name", "version", found.alias("advisories"))
