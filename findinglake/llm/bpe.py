"""Byte-level BPE with a rank queue made of a hierarchical bitmap.

A pre-token is a linked list of byte positions. Each position whose pair with
its right neighbour has a merge rank lies in that rank's bucket. A bitmap over
the ranks in two levels says which buckets hold anything; find-first-set on
both levels gives the lowest rank. The leftmost position of that bucket is
merged, and the two pairs that this changes are put into their new buckets.
Entries they had before stay where they are and are skipped when they come up,
because the pair at that position no longer has the bucket's rank. The cost of
a pre-token is n log n at worst, whatever its length.

Cases: a null or empty text has no ids; lone long pre-tokens are encoded like
any other but not remembered; repeated rows give equal rows; ids outside the
vocabulary raise ValueError when decoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BATCH_CHARS

#: Pre-tokens of more characters are not remembered; bytes that each of two generations of remembered ones may take.
REMEMBERED_CHARS, REMEMBERED_BYTES = 48, 48 << 20
#: What a dictionary takes for an entry besides its text and ids.
_ENTRY_BYTES = 180
_WORD_BITS = 8
_WORD = (1 << _WORD_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit integers.

    What is remembered has two generations: when the young one is full it becomes the old one, and what is met again
    comes back into the young one. So frequent pre-tokens are never forgotten all at once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self._ranks = ranks
        self._leaves = [0] * ((max(ranks.values(), default=0) >> _WORD_BITS) + 1)
        self._split = regex.compile(pattern).findall
        self._old: dict[str, bytes] = {}
        self._bytes = 0
        # The ranks of all pairs of bytes, and the ids of single ones, without hashing.
        self._pairs = [-1] * (1 << 16)
        for token, rank in ranks.items():
            if len(token) == 2:
                self._pairs[token[0] << 8 | token[1]] = rank
        self._single = [ranks.get(bytes([b])) for b in range(256)]

    def __missing__(self, token: str) -> bytes:
        ids = self._old.get(token)
        if ids is None:
            ids = np.array(self.merge(token.encode()), "<u4").tobytes()
        if len(token) <= REMEMBERED_CHARS:
            self._bytes += _ENTRY_BYTES + len(token) + len(ids)
            if self._bytes > REMEMBERED_BYTES:
                self._old = dict(self)
                self.clear()
                self._bytes = 0
            self[token] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        whole = self._ranks.get(piece)
        if whole is not None:
            return [whole]
        pairs, single = self._pairs, self._single
        pair = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        if max(pair, default=-1) < 0:
            return [single[b] for b in piece]
        if len(piece) == 3:  # one merge, after which nothing else can be
            first, second = pair
            if second < 0 or 0 <= first <= second:
                return [first, single[piece[2]]]
            return [single[piece[0]], second]
        return self._by_rank(piece, pair)

    def _by_rank(self, piece: bytes, pair: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank until none is left; `pair` has the rank at each position or -1.

        The bitmap is two levels deep: `top` says which words of `leaves` are not zero. Both are empty before and after.
        """
        n, ranks, leaves, rank_of = len(piece), self._ranks, self._leaves, self._ranks.get
        pair.append(-1)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        buckets: dict[int, list[int]] = {}
        top = 0
        for at, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [at]
                    leaves[rank >> _WORD_BITS] |= 1 << (rank & _WORD)
                    top |= 1 << (rank >> _WORD_BITS)
                else:
                    bucket.append(at)
        while top:
            leaf = (top & -top).bit_length() - 1
            word = leaves[leaf]
            rank = leaf << _WORD_BITS | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                word &= word - 1
                leaves[leaf] = word
                if not word:
                    top &= top - 1
            if pair[at] != rank:
                continue
            right = after[at]
            end = after[right]
            after[at] = end
            pair[right] = -1
            if end < n:
                before[end] = at
                new = rank_of(piece[at : after[end]], -1)
            else:
                new = -1
            pair[at] = new
            left = before[at]
            changed = ((at, new),)
            if left >= 0:
                pair[left] = beside = rank_of(piece[left:end], -1)
                changed = ((at, new), (left, beside))
            for place, rank in changed:
                if rank >= 0:
                    bucket = buckets.get(rank)
                    if bucket is None:
                        buckets[rank] = [place]
                        leaves[rank >> _WORD_BITS] |= 1 << (rank & _WORD)
                        top |= 1 << (rank >> _WORD_BITS)
                    else:
                        heappush(bucket, place)
        ids, at = [], 0
        while at < n:
            end = after[at]
            ids.append(ranks[piece[at:end]])
            at = end
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join([self[token] for token in self._split(text or "")])


class Decoder:
    """The bytes of ids, a whole batch at a time: tokens are taken by id into one array, which is cut where texts end."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._tokens = pa.array(tokens, pa.large_binary())
        self._lengths = np.array([-1 if token is None else len(token) for token in tokens], np.int64)

    def decode(self, texts: list[bytes | None]) -> pa.Array:
        ids = np.frombuffer(b"".join([t or b"" for t in texts]), "<u4")
        if len(ids) and (int(ids.max()) >= len(self._lengths) or int(self._lengths[ids].min()) < 0):
            unknown = next(i for i in ids.tolist() if i >= len(self._lengths) or self._lengths[i] < 0)
            raise ValueError(f"id {unknown} is not in the vocabulary")
        ends = np.cumsum([0, *(len(t or b"") // 4 for t in texts)])
        places = np.concatenate([[0], np.cumsum(self._lengths[ids])])[ends]
        joined = self._tokens.take(pa.array(ids)).buffers()[2] if len(ids) else pa.py_buffer(b"")
        return pa.Array.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(places.astype(np.int64).tobytes()), joined]
        ).cast(pa.binary())


_LOADED: dict[tuple, Encoder | Decoder] = {}


def _loaded(kind: type, digest: str, ranks, *more):
    """One encoder or decoder for each Python worker and vocabulary, which outlives a task.

    A worker that has it does not load the vocabulary again with each query's broadcast.
    """
    key = (kind, digest, *more)
    if key not in _LOADED:
        _LOADED[key] = kind(ranks.value, *more)
    return _LOADED[key]


def _sent(df: DataFrame, path: str):
    """A digest of the vocabulary and its broadcast."""
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    return digest, df.sparkSession.sparkContext.broadcast(load_ranks(path))


def _pieces(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the values of column `at` take at most `most` bytes, or are one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def _mapped(df: DataFrame, first: str, row_id: str, more: list[Column], outcome, fields: list[pa.Field]) -> DataFrame:
    """The id and what `outcome` makes of column `first`, piece by piece; the id keeps its type."""
    kind = df.schema[row_id].dataType
    schema = pa.schema([pa.field("row_id", to_arrow_type(kind)), *fields])
    names = {pa.int64(): "long", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1, BATCH_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column(0), *outcome(batch)], schema=schema)

    narrow = df.select(F.col(row_id).alias("row_id"), F.col(first).alias("value"), *more)
    ddl = ", ".join([f"row_id {kind.simpleString()}", *(f"{f.name} {names[f.type]}" for f in fields)])
    return narrow.mapInArrow(run, ddl).withColumnRenamed("row_id", row_id)


_IDS = [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())]
_DECODED = pa.field("decoded", pa.binary())


def _counted(ids: list[bytes]) -> list[pa.Array]:
    return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per input row: the id, `n_tokens` and `ids` (little-endian unsigned 32-bit integers).

    The vocabulary, a file of fixed size, is read once on the driver and broadcast.
    """
    digest, ranks = _sent(df, path)

    def outcome(batch):
        return _counted(list(map(_loaded(Encoder, digest, ranks, pattern).encode, batch.column(1).to_pylist())))

    return _mapped(df, text, row_id, [], outcome, _IDS)


def decode(df: DataFrame, path: str, ids: str = "ids", row_id: str = "doc_id") -> DataFrame:
    """The rows of `encode` with `decoded`, the bytes that the ids stand for."""
    digest, ranks = _sent(df, path)

    def outcome(batch):
        texts = batch.column(1).to_pylist()
        return [batch.column(2), batch.column(1), _loaded(Decoder, digest, ranks).decode(texts)]

    return _mapped(df, ids, row_id, [F.col("n_tokens")], outcome, [*_IDS, _DECODED])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """`decode` of `encode` in one pass of a worker: the ids that go out are the ids that are decoded."""
    digest, ranks = _sent(df, path)

    def outcome(batch):
        ids = list(map(_loaded(Encoder, digest, ranks, pattern).encode, batch.column(1).to_pylist()))
        return [*_counted(ids), _loaded(Decoder, digest, ranks).decode(ids)]

    return _mapped(df, text, row_id, [], outcome, [*_IDS, _DECODED])
