"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words and words become hashes of five-word grams. Of every six
grams in a row the smallest is a fingerprint, so any ten words that two texts
share hold a fingerprint at the same place in both. Fingerprints of documents
and items are joined; from each hit the ten-word windows around it are compared
(a window is its two five-word grams, 128 bits) and those that agree are kept.
Every equally small gram is a fingerprint, so ties cannot be decided differently
in two texts.

Items of fewer than ten words are one window of their own length; the lengths
that occur, nine at most, are joined on all grams of that length.

Items with equal words are one class while joining, so copies in the benchmark
do not multiply hits. A row is told from others by its id and its text's hash.

Cases: a null text has no words and no hits; an item without words has no
window, and one without id counts for hits but is not listed; documents
without id get a row like any other; repeated rows give repeated rows; with an
empty benchmark nothing is hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key

GRAM, WINDOW = 5, 10
_RUN = WINDOW - GRAM + 1
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and anything beyond ASCII, with A-Z lower-cased."""
    spaced = F.translate(text, _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(F.coalesce(spaced, F.lit("")), " "), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))


def _indexes(size: Column) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, length: int, hashed=F.xxhash64) -> Column:
    """A hash of each `length` successive elements."""
    return F.transform(
        _indexes(F.size(hashes) - (length - 1)), lambda at: hashed(*(F.get(hashes, at + k) for k in range(length)))
    )


def _hashed_words(df: DataFrame, text: str, **keep: Column) -> DataFrame:
    kept = [c.alias(name) for name, c in keep.items()]
    return df.select(*kept, words(F.col(text)).alias("_words")).select(
        *keep, F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes")
    )


def fingerprints(hashed: DataFrame, *keep: str) -> DataFrame:
    """`at`, `gram` and `around`, the grams from five before to five after, for each winnowed place of `_hashes`."""
    # No filters on these arrays: one would be pushed below and carry their whole computation into its lambdas.
    grams = hashed.select(*keep, _grams(F.col("_hashes"), GRAM).alias("_grams"))
    g, m = F.col("_grams"), F.col("_least")
    least = F.transform(_indexes(F.size(g) - (_RUN - 1)), lambda at: F.least(*(F.get(g, at + k) for k in range(_RUN))))
    chosen = F.filter(
        _indexes(F.size(g)), lambda at: F.get(g, at) == F.greatest(*(F.get(m, at - k) for k in range(_RUN)))
    )
    places = grams.select(*keep, "_grams", least.alias("_least")).select(*keep, "_grams", F.explode(chosen).alias("at"))
    around = F.array(*(F.get("_grams", F.col("at") + k) for k in range(1 - _RUN, _RUN)))
    return places.select(*keep, "at", F.get("_grams", F.col("at")).alias("gram"), around.alias("around"))


def short_grams(hashed: DataFrame, length: int, *keep: str) -> DataFrame:
    """`at`, `gram` and `check`, two hashes of each run of `length` words."""
    h = F.col("_hashes")
    places = hashed.select(*keep, "_hashes", F.explode(_indexes(F.size(h) - (length - 1))).alias("at"))
    run = [F.get("_hashes", F.col("at") + k) for k in range(length)]
    return places.select(*keep, "at", F.xxhash64(*run).alias("gram"), F.hash(*run).alias("check"))


def hits(documents: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """(_id, _key, start, length, class) of every window of an item class in a document; a hit may stand twice.

    `documents` has _id, _key and _hashes; `items` has class and _hashes; `lengths` are those of short items.
    """
    ours = fingerprints(items, "class").select("class", "gram", F.col("around").alias("_around"))
    met = fingerprints(documents, "_id", "_key").join(ours, "gram")
    agree = [
        F.when(
            (F.get("around", F.lit(_RUN - 1 - k)) == F.get("_around", F.lit(_RUN - 1 - k)))
            & (F.get("around", F.lit(_RUN - 1 - k + GRAM)) == F.get("_around", F.lit(_RUN - 1 - k + GRAM))),
            F.col("at") - k,
        )
        for k in range(_RUN)
    ]
    found = [
        met.select("_id", "_key", F.explode(F.array_compact(F.array(*agree))).alias("start"), F.lit(WINDOW).alias("length"), "class")
    ]
    for length in lengths:
        short = short_grams(items.where(F.size("_hashes") == length), length, "class").drop("at")
        found.append(
            short_grams(documents, length, "_id", "_key").join(short, ["gram", "check"])
            .select("_id", "_key", F.col("at").alias("start"), F.lit(length).alias("length"), "class")
        )
    return reduce(DataFrame.unionAll, found)


def contamination(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """One row per document row: the id, `n_words`, `n_hit`, `n_items`, `items` (sorted ids as strings), `spans`."""
    hashed_items = _hashed_words(benchmark, item_text, item=F.col(item_id).cast("string")).where(
        F.size("_hashes") > 0
    ).withColumn("class", F.xxhash64("_hashes"))
    named = hashed_items.groupBy("class").agg(F.collect_set("item").alias("class_items"))
    items = hashed_items.groupBy("class").agg(F.first("_hashes").alias("_hashes"))
    lengths = sorted(r[0] for r in items.select(F.size("_hashes")).where(F.size("_hashes") < WINDOW).distinct().collect())
    key = {"_id": F.col(row_id), "_key": text_key(F.col(text))}
    found = hits(_hashed_words(documents, text, **key), items, lengths)
    per_class = found.groupBy("_id", "_key", "class").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    per_document = per_class.join(named, "class").groupBy("_id", "_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("class_items")))).alias("items"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)
    ))))
    marked = per_document.select("_id", "_key", "spans", "items", covered.cast("long").alias("n_hit"))
    rows = documents.select(*(c.alias(n) for n, c in key.items()), n_words(F.col(text)).cast("long").alias("n_words"))
    same = rows["_id"].eqNullSafe(marked["_id"]) & (rows["_key"] == marked["_key"])
    return rows.join(marked, same, "left").select(
        rows["_id"].alias(row_id), rows["_key"].alias("text_key"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    )
