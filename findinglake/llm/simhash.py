"""SimHash near-duplicates by a grid over segment bit counts.

A fingerprint is cut into 32 segments of two bits; its embedding is the number
of set bits in each. One differing bit changes one coordinate by one, so the
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. Within three bits, one half of the segments (16 coordinates) is
at a Manhattan distance of one at most. So each half is a grid of unit cells: a
fingerprint is stored in its cell and looks into that cell and those one step
up; the pair is seen by whichever lies lower. Candidates are verified exactly
as they meet. Equal fingerprints are one node, so copies never become pairs.

`similar` decides by the Jaccard similarity of sets of five-word shingles
instead; it has its candidates from the rarest shingles. No query uses it.

Links become components by alternating large and small stars, with the edge
list checkpointed in the shared folder each round.

Cases: null or empty text has fingerprint zero; fewer words than a shingle are
one shingle; null ids take part but never name a component (all null: null);
repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, map_rows, stored, text_key

MAX_BITS = 3
#: Words in a shingle of the similarity that `similar` asks for; common shingles that are broadcast to order the rest.
WORDS, COMMON = 5, 1 << 17
#: Candidate pairs for each row of a token table up to which all are decided at once, and turns before that anyway.
MANY, TURNS = 8, 6


def _grams(words: list[bytes], length: int) -> list[bytes]:
    """Space-joined shingles; the whole sequence if it is shorter."""
    if length == 1 or len(words) < length:
        return words if length == 1 else [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[k:] for k in range(length)))))


def majority(digests: bytes, width: int) -> np.ndarray:
    """Packed bits set in over half of the digests of `width` bytes each."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, width)
    set_bits = np.zeros(8 * width, np.int64)
    for start in range(0, len(rows), 255):
        set_bits += np.unpackbits(rows[start : start + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_bits > len(rows))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    return int.from_bytes(majority(b"".join([digest(g, seed) for g in _grams(words, shingle)]), 8).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", row_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """The id, `text_key` and `bits`, the fingerprint as a signed long."""

    def row(key, tell, value):
        bits = fingerprint(value, shingle)
        return key, tell, bits - (1 << 64) if bits >> 63 else bits

    key_type = df.schema[row_id].dataType
    return map_rows(
        df, [F.col(row_id), text_key(F.col(text)), F.col(text)], row, "row_id, text_key long, bits long",
        pa.schema([("text_key", pa.int64()), ("bits", pa.int64())]),
    ).select(F.col("row_id").cast(key_type).alias(row_id), "text_key", "bits")


def _cells(bits: Column) -> list[Column]:
    """The grid cells of both halves: bit counts of two-bit segments, packed two bits each."""
    halves = [F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(0xFFFFFFFF))]
    return [half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555)) for half in halves]


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints in column `bits` within MAX_BITS bits; a pair may stand twice."""
    cells = _cells(F.col("bits"))
    stored_in = nodes.select(
        F.col("bits").alias("b"),
        F.inline(F.array(*(F.struct(F.lit(k).alias("half"), cell.alias("cell")) for k, cell in enumerate(cells)))),
    )
    looks = [
        F.struct(F.lit(k).alias("half"), cell.alias("cell"), F.lit(True).alias("same"))
        for k, cell in enumerate(cells)
    ] + [
        F.when(
            F.shiftrightunsigned(cell, 2 * at).bitwiseAND(F.lit(3)) < 2,
            F.struct(F.lit(k).alias("half"), (cell + F.lit(1 << 2 * at)).alias("cell"), F.lit(False).alias("same")),
        )
        for k, cell in enumerate(cells)
        for at in range(16)
    ]
    looking = nodes.select(F.col("bits").alias("a"), F.inline(F.array_compact(F.array(*looks))))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return looking.join(stored_in, ["half", "cell"]).where(close & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge list (a, b); the root is the smallest node reached."""
    edges = stored(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "edges"
    )
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("r")).select("v", F.least("v", "r").alias("r"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("r").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(least, "v").where("m <> r").select(F.col("m").alias("v"), F.col("r").alias("m"))
        before = edges
        edges = stored(small.unionAll(least.select("v", F.col("r").alias("m"))).distinct(), "edges")
        discard(before)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("m").alias("root")).unionAll(roots)


def near_duplicates(df: DataFrame, text: str = "text", row_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """One row per input row: the id, `text_key`, `bits`, and `component_id`, the smallest id of its component."""
    prints = stored(fingerprints(df, text, row_id, shingle), "fingerprints")
    nodes = prints.groupBy("bits").agg(F.min(row_id).alias("least_id"))
    member = nodes.join(components(links(nodes.select("bits"))), nodes["bits"] == F.col("node"), "left").select(
        "bits", "least_id", F.coalesce("root", "bits").alias("root")
    )
    named = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(member.select("bits", "root").join(named, "root"), "bits").select(row_id, "text_key", "bits", "component_id")


def shingles(text: str | None) -> np.ndarray:
    """The different five-word shingles as sorted 64-bit hashes; fewer words are one shingle, none is none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    length = min(WORDS, len(words))
    mixed = np.full(len(words) - length + 1, length, np.uint64)
    for k in range(length):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((mixed ^ (mixed >> np.uint64(32))).view(np.int64))


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), ends[1:-1] - ends[0]) if len(column) else []


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that stand in many texts, `COMMON` at most, and in how many.

    They only order the shingles of a text, so that what many share comes last: one that is missing costs time, no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def handed() -> Iterator[pa.RecordBatch]:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            values, n = values[n > 1], n[n > 1]
            for start in range(0, len(values), 1 << 16):
                part = slice(start, start + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(values[part]), pa.array(n[part].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > 500_000:
                yield from handed()
                held, size = [], 0
        if size:
            yield from handed()

    counts = stored(sets.select("grams").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "common")
    scale = F.floor(F.log2("n")).alias("scale")
    least, taken = 64, 0
    for r in sorted(counts.groupBy(scale).count().collect(), key=lambda r: -r["scale"]):
        taken += r["count"]
        if taken > COMMON:
            break
        least = r["scale"]
    rows = counts.where(scale >= least).toPandas().sort_values("token")
    return rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _prefixes(sets: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, size, rare): the fewest shingles, rarest first, of which two sets that share 0.8 have one in common.

    Sets that share 0.8 have 0.8 of the larger in common, so with one order for all texts they meet in what is left
    of each after 0.8 of it is put aside, and one more.
    """
    sent = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = sent.value
        for batch in batches:
            rare = []
            for found in _lists(batch.column(2)):
                n = np.zeros(len(found), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    n = np.where(known[place] == found, times[place], 0)
                rare.append(found[np.argsort(n, kind="stable")[: len(found) + 4 * len(found) // -5 + 1]] if len(found) else found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rare, pa.list_(pa.int64()))], names=["node", "size", "rare"])

    return sets.select("node", "size", "grams").mapInArrow(run, "node long, size int, rare array<long>")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets share 0.8, counted on the whole sets, which stay in their buckets.

    First the counts of hashes by their last byte are compared: the lesser ones add up to no less than what two sets
    share, so a pair that they rule out is not alike, and only for the others does a set travel to another.
    """
    counts = sets.select("node", "size", "counts")
    left = counts.select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("counts").alias("a_counts"))
    right = counts.select(F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("counts").alias("b_counts"))
    most = F.aggregate(F.zip_with("a_counts", "b_counts", lambda x, y: F.least(x, y)), F.lit(0), lambda total, n: total + n)
    likely = pairs.join(left, "a").join(right, "b").where(9 * most >= 4 * (F.col("a_size") + F.col("b_size")))
    pairs = stored(likely.select("a", "b"), "likely")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("left")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("right")), "b")
    both = F.size(F.array_intersect("left", "right"))
    return met.where(9 * both >= 4 * (F.size("left") + F.size("right"))).select("a", "b")


def _linked(rare: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of all nodes that link, from (token, node, size): every pair that shares a token is decided.

    While the pairs are many against the rows, a turn takes two nodes of each token, one inside its largest component
    and one outside, and decides each against all others; nodes that are joined by then need no decision. Then all
    pairs of different components are decided: one of the two is always outside the largest.
    """
    state = stored(rare.withColumn("root", F.col("node")).withColumn("used", F.lit(False)), "tokens")
    found, turn, done = None, 0, False
    while not done:
        sizes = state.groupBy("token", "root").agg(F.count("*").alias("k"))
        open_ = sizes.groupBy("token").agg(
            F.max_by("root", F.struct("k", "root")).alias("largest"), F.sum("k").alias("n"), F.max("k").alias("most")
        ).where("n > most")
        open_ = stored(open_, "open")
        pairs, rows = open_.agg(F.sum(F.expr("(n - most) * n")), F.sum("n")).first()
        if pairs is None:
            break
        live = state.join(open_.select("token", "largest"), "token")
        inside = F.col("root") == F.col("largest")
        done = pairs <= MANY * rows or turn == TURNS
        if done:
            picked = live.where(~inside)
        else:
            order = F.struct("used", F.xxhash64("node", F.lit(turn)))
            picked = live.groupBy("token", inside.alias("inside")).agg(F.min_by(F.struct("node", "root", "size"), order).alias("p"))
            picked = picked.select("token", "p.*")
        picked = picked.select("token", F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("size").alias("p_size"))
        fits = (5 * F.col("size") >= 4 * F.col("p_size")) & (5 * F.col("p_size") >= 4 * F.col("size"))
        met = live.join(picked, "token").where((F.col("root") != F.col("p_root")) & fits)
        met = stored(met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), "pairs")
        links_ = stored(_alike(met, sets), "links")
        discard(met)
        found = links_ if found is None else found.unionAll(links_)
        if not done:
            used = picked.select(F.col("p").alias("node"), F.lit(True).alias("taken")).distinct()
            roots = components(found)
            after = state.drop("root").join(roots, "node", "left").join(used, "node", "left")
            after = stored(
                after.select(
                    "token", "node", "size", F.coalesce("root", "node").alias("root"),
                    (F.col("used") | F.coalesce("taken", F.lit(False))).alias("used"),
                ),
                "tokens",
            )
            discard(state, roots)
            state = after
            turn += 1
        discard(open_)
    discard(state)
    return components(found if found is not None else rare.select(F.col("node").alias("a"), F.col("node").alias("b")))


def similar(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Groups of texts linked by pairs that share 0.8 or more of their different five-word shingles.

    One row per input row: the id, `text_key` and `component_id`, the smallest id of its group. Texts with the same
    shingles are one node. Nodes that share one of their rarest shingles are candidates, which no pair at 0.8 escapes
    (`_prefixes`), and the whole sets decide.
    """

    def node_of(grams: np.ndarray) -> int:
        node = xxhash.xxh64_intdigest(grams.tobytes())
        return node - (1 << 64) if node >> 63 else node

    def named(key, tell, value):
        return key, tell, node_of(shingles(value))

    def shingled(key, value):
        grams = shingles(value)
        counts = np.bincount(grams.astype(np.uint64).astype(np.uint8), minlength=256)
        return key, node_of(grams), len(grams), counts, grams

    rows = stored(map_rows(
        df, [F.col(row_id), text_key(F.col(text)), F.col(text)], named, "row_id, text_key long, node long",
        pa.schema([("text_key", pa.int64()), ("node", pa.int64())]),
    ), "rows")
    # Texts are shingled once more here: the sets of one text for each node are stored, and no others.
    sets = map_rows(
        df, [F.col(row_id), F.col(text)], shingled, "row_id, node long, size int, counts array<int>, grams array<long>",
        pa.schema([("node", pa.int64()), ("size", pa.int32()), ("counts", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64()))]),
    ).groupBy("node").agg(
        F.min("row_id").alias("least_id"), *(F.any_value(c).alias(c) for c in ("size", "counts", "grams"))
    )
    sets = bucketed(sets, "sets", "node")
    nodes = stored(sets.select("node", "least_id"), "nodes")
    prefixes = stored(_prefixes(sets, _common(sets)).select("node", "size", F.explode("rare").alias("token")), "prefixes")
    shared = prefixes.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")
    rare = stored(prefixes.join(shared, "token"), "rare")
    discard(prefixes)
    linked = stored(_linked(rare, sets), "linked")
    discard(rare, sets)
    member = nodes.select("node", "least_id").join(linked, "node", "left")
    member = member.select("node", "least_id", F.coalesce("root", "node").alias("root"))
    named = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = member.select("node", "root").join(named, "root").select("node", "component_id")
    return rows.select("row_id", "text_key", "node").join(by_node, "node").select(
        F.col("row_id").cast(df.schema[row_id].dataType).alias(row_id), "text_key", "component_id"
    )


def hex_of(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
