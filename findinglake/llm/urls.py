"""URL filters: rules by host and path, looked up in sorted arrays of digests that tasks map from a file.

A rule is a host and a path; it fits its host and every subdomain of it if the
URL's path starts with the rule's. Of the rules that fit, the longest decides
(host and path together, then the longer host); where none fits, the URL is on
no list and is allowed.

The list becomes segments. A segment holds entries for a range of host digests:
one for each rule host, with the lengths of its paths, and one for each rule.
Its 64-bit keys (XXH64, seed 42) are one sorted array; the entries' strings lie
behind it. Spark sorts and writes the segments to the shared folder and sends
their files to the executors, where tasks map them into memory: workers of a
machine share the pages, and a URL list is never held by the driver or on a
heap. A batch of URLs is looked up at once by binary search, first its host's
suffixes, then host and path prefix for the lengths that the host has. A key
that is found counts only if the stored string is the one asked for.

Segments go out in groups of at most `MAPPED_BYTES`. A longer list takes several
passes over the URLs, each keeping the best rule so far.

Cases: a null URL, or one without `://`, has an empty host and path and meets no
rule; an empty path starts with no rule's but an empty one; host labels beyond
those of the deepest rule are never looked at, so very long hosts cost nothing;
a rule with a null part, an empty host or another verdict than allow and block
is left out; a rule that stands twice counts once, and blocks if either does; no
rules: everything is allowed; repeated rows give repeated rows.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lower_ascii, stored

#: Bytes of entries in one segment, and of segments that one pass sends to an executor's disk.
SEGMENT_BYTES, MAPPED_BYTES = 256 << 20, 8 << 30
SEED = 42
_HOST, _RULE = "h", "r"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_of(entry: str) -> int:
    """XXH64 as the signed number that Spark's xxhash64 gives."""
    key = xxhash.xxh64_intdigest(entry.encode(), SEED)
    return key - (1 << 64) if key >> 63 else key


@dataclass(frozen=True)
class Segment:
    """A file of entries: the host digests it covers, and its size."""

    file: str
    least: int
    most: int
    bytes: int


@dataclass(frozen=True)
class UrlIndex:
    segments: tuple[Segment, ...]
    #: Labels of the deepest rule host.
    labels: int


def build_index(rules: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> UrlIndex:
    """Segments of a list of rules (host, path, verdict), written to the shared folder by Spark."""
    known = rules.select(lower_ascii(F.col("host")).alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict"))
    known = known.where("host <> '' and path is not null and verdict in ('allow', 'block')")
    known = known.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"))
    place = F.xxhash64(F.concat(F.lit(_HOST), "host"))
    hosts = known.groupBy("host").agg(F.sort_array(F.collect_set(F.char_length("path"))).alias("lengths")).select(
        place.alias("place"), F.concat(F.lit(_HOST), "host").alias("entry"), "lengths", F.lit(False).alias("block")
    )
    paths = known.select(
        place.alias("place"), F.concat(F.lit(_RULE), "host", "path").alias("entry"), F.array().cast("array<int>").alias("lengths"), "block"
    )
    entries = stored(hosts.unionAll(paths).withColumn("key", F.xxhash64("entry")), "url_entries")
    bytes_ = F.sum(F.octet_length("entry") + 4 * F.size("lengths") + 21)
    total, labels = entries.agg(
        bytes_, F.max(F.when(F.col("entry").startswith(_HOST), F.size(F.split("entry", r"\."))))
    ).first()
    if not total:
        return UrlIndex((), 0)
    sorted_ = stored(entries.repartitionByRange(-(-total // segment_bytes), "place").sortWithinPartitions("key", "entry"), "url_segments")
    files = sorted_.groupBy(F.input_file_name().alias("file")).agg(
        F.min("place").alias("least"), F.max("place").alias("most"), bytes_.alias("bytes")
    )
    return UrlIndex(tuple(sorted((Segment(*r) for r in files.collect()), key=lambda s: s.least)), labels)


class Mapped:
    """A segment's arrays, mapped from files that are made once for each executor out of the file Spark sent."""

    def __init__(self, file: str):
        folder = f"{file}.arrays"
        if not os.path.isdir(folder):
            made = f"{folder}-{uuid.uuid4().hex}"
            os.mkdir(made)
            self._unpack(file, made)
            try:
                os.rename(made, folder)
            except OSError:  # another worker was first
                shutil.rmtree(made)
        self.keys = np.load(f"{folder}/keys.npy", mmap_mode="r")
        self._ends = np.load(f"{folder}/ends.npy", mmap_mode="r")
        self._lengths_end = np.load(f"{folder}/lengths_end.npy", mmap_mode="r")
        self._block = np.load(f"{folder}/block.npy", mmap_mode="r")
        self._text = np.memmap(f"{folder}/text", np.uint8, "r")
        self._lengths = np.memmap(f"{folder}/lengths", np.int32, "r")

    @staticmethod
    def _unpack(file: str, folder: str) -> None:
        columns: dict[str, list[np.ndarray]] = {"keys": [], "ends": [], "lengths_end": [], "block": []}
        at = lengths_at = 0
        with pq.ParquetFile(file) as rows, open(f"{folder}/text", "wb") as text, open(f"{folder}/lengths", "wb") as lengths:
            for batch in rows.iter_batches(columns=["key", "entry", "lengths", "block"]):
                entries = [e.encode() for e in batch.column("entry").to_pylist()]
                own = [np.array(found, np.int32) for found in batch.column("lengths").to_pylist()]
                text.write(b"".join(entries))
                lengths.write(b"".join(found.tobytes() for found in own))
                columns["keys"].append(batch.column("key").to_numpy())
                columns["ends"].append(at + np.cumsum([len(e) for e in entries]))
                columns["lengths_end"].append(lengths_at + np.cumsum([len(found) for found in own]))
                columns["block"].append(batch.column("block").to_numpy(zero_copy_only=False))
                at, lengths_at = int(columns["ends"][-1][-1]), int(columns["lengths_end"][-1][-1])
            if not lengths_at:
                lengths.write(bytes(4))  # an empty file cannot be mapped
        for name, parts in columns.items():
            np.save(f"{folder}/{name}.npy", np.concatenate(parts))

    def find(self, entries: list[str]) -> list[int]:
        """The row of each entry, -1 where there is none: binary search of all keys, then the strings are compared."""
        keys = np.fromiter(map(key_of, entries), np.int64, len(entries))
        rows = np.searchsorted(self.keys, keys)
        found = []
        for row, key, entry in zip(rows.tolist(), keys.tolist(), entries):
            wanted = entry.encode()
            while row < len(self.keys) and self.keys[row] == key and self._entry(row) != wanted:
                row += 1  # another string with the same digest
            found.append(row if row < len(self.keys) and self.keys[row] == key else -1)
        return found

    def _entry(self, row: int) -> bytes:
        return self._text[self._ends[row - 1] if row else 0 : self._ends[row]].tobytes()

    def lengths(self, row: int) -> list[int]:
        return self._lengths[self._lengths_end[row - 1] if row else 0 : self._lengths_end[row]].tolist()

    def block(self, row: int) -> bool:
        return bool(self._block[row])


@lru_cache(maxsize=1024)
def _mapped(file: str) -> Mapped:
    return Mapped(file)


def longest(hosts: list[str], paths: list[str], segments: list[tuple[int, Mapped]], labels: int) -> list[tuple[str, str, bool] | None]:
    """For each URL the longest rule that fits: host, path, and whether it blocks. `segments` by least host digest."""
    least = np.array([start for start, _ in segments], np.int64)
    asked: list[list[tuple[int, str]]] = [[] for _ in segments]
    for at, host in enumerate(hosts):
        tail = host.rsplit(".", labels)[-labels:] if host else []
        for k in range(len(tail)):
            suffix = ".".join(tail[k:])
            segment = int(np.searchsorted(least, key_of(_HOST + suffix), side="right")) - 1
            if segment >= 0:
                asked[segment].append((at, suffix))
    best: list[tuple[str, str, bool] | None] = [None] * len(hosts)
    for (_, mapped), wanted in zip(segments, asked):
        fits = []
        for (at, suffix), row in zip(wanted, mapped.find([_HOST + suffix for _, suffix in wanted])):
            if row >= 0:
                fits += [(at, suffix, paths[at][:n]) for n in mapped.lengths(row) if n <= len(paths[at])]
        for (at, host, path), row in zip(fits, mapped.find([_RULE + host + path for _, host, path in fits])):
            if row >= 0:
                old = best[at]
                if old is None or (len(host) + len(path), len(host)) > (len(old[0]) + len(old[1]), len(old[0])):
                    best[at] = host, path, mapped.block(row)
    return best


def _passes(segments: tuple[Segment, ...], most: int) -> Iterator[list[Segment]]:
    group: list[Segment] = []
    for segment in segments:
        if group and sum(s.bytes for s in group) + segment.bytes > most:
            yield group
            group = []
        group.append(segment)
    if group:
        yield group


def judge(
    df: DataFrame, index: UrlIndex, url: str = "url", row_id: str = "page_id", default: str = "allow", mapped_bytes: int = MAPPED_BYTES
) -> DataFrame:
    """One row per input row: the id, `host`, `path`, `rule` (host and path of the deciding one, else null) and `verdict`."""
    key_type = df.schema[row_id].dataType
    none = F.lit(None).cast("string")
    rows = df.select(
        F.col(row_id).alias("row_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        none.alias("rule_host"), none.alias("rule_path"), F.lit(None).cast("boolean").alias("block"),
    )
    schema = pa.schema([
        ("row_id", to_arrow_type(key_type)), *((name, pa.string()) for name in ("host", "path", "rule_host", "rule_path")), ("block", pa.bool_()),
    ])
    passes = list(_passes(index.segments, mapped_bytes))
    for number, group in enumerate(passes):
        for segment in group:
            df.sparkSession.sparkContext.addFile(segment.file)
        rows = rows.mapInArrow(_pass(group, index.labels, schema), rows.schema)
        if number + 1 < len(passes):
            rows = stored(rows, "urls")
    return rows.select(
        F.col("row_id").alias(row_id), "host", "path", F.concat("rule_host", "rule_path").alias("rule"),
        F.when(F.col("block"), "block").when(~F.col("block"), "allow").otherwise(default).alias("verdict"),
    )


def _pass(group: list[Segment], labels: int, schema: pa.Schema):
    sent = [(segment.least, os.path.basename(segment.file)) for segment in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = [(least, _mapped(SparkFiles.get(name))) for least, name in sent]
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            before = zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))
            best = []
            for new, (host, path, block) in zip(longest(hosts, paths, segments, labels), before):
                if new is None or host is not None and (len(host) + len(path), len(host)) > (len(new[0]) + len(new[1]), len(new[0])):
                    new = host, path, block
                best.append(new)
            columns = [pa.array(values, field.type) for values, field in zip(zip(*best), list(schema)[3:])] if best else batch.columns[3:]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], schema=schema)

    return run
