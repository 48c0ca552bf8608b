"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three
letters, words padded with a space) in order of frequency. Profiles of the
languages come from the n-gram counts of all training texts: each task counts
its texts, Spark sums the counts, and the most frequent of each language are
kept. A document's profile is compared with each language's by the out-of-place
distance: how far each of its n-grams stands from its rank in the language, or
the longest distance if it is not there.

Profiles are a fixed number of n-grams for each language, so what reaches the
driver is bounded by the number of languages.

Cases: a text that is null or has no letter is `und` with score 0; equal
distances go to the language that sorts first; equal counts rank by n-gram; an
empty training set labels everything `und`; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

UNDETERMINED = "und"
#: n-grams in a profile, of a language and of a document.
PROFILE = 500
#: Different n-grams that a task counts for a language before it hands the counts on.
_HELD = 300_000
_BITS = 21


def grams(text: str | None) -> np.ndarray:
    """The 1- to 3-grams of a text's letter runs, lower-cased, as sorted code-point keys; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    if not len(points):
        return points
    used = np.unique(points)
    letters = used[[chr(p).isalpha() for p in used.tolist()]]
    if not len(letters):
        return letters
    at = np.searchsorted(letters, points)
    at[at == len(letters)] = 0
    is_letter = letters[at] == points
    cleaned = np.where(is_letter, points, 32)
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])
    cleaned = np.concatenate([[32], cleaned[keep], [32]])
    two = cleaned[:-1] << _BITS | cleaned[1:]
    three = two[:-1] << _BITS | cleaned[2:]
    two = two[(cleaned[:-1] != 32) | (cleaned[1:] != 32)]
    three = three[cleaned[1:-1] != 32]
    return np.sort(np.concatenate([cleaned[cleaned != 32], two, three]))


def counted(sorted_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1]]))
    return sorted_grams[starts], np.diff(np.concatenate([starts, [len(sorted_grams)]]))


def profile(text: str | None, size: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, the most frequent first, ties by key."""
    found = grams(text)
    if not len(found):
        return found
    keys, counts = counted(found)
    if len(keys) > size:
        # The size-th largest count decides; of those equal to it the smallest keys stay.
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        above = np.flatnonzero(counts > least)
        keep = np.sort(np.concatenate([above, np.flatnonzero(counts == least)[: size - len(above)]]))
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")]


def learn(df: DataFrame, text: Column, language: Column, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language, from all rows with a language and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def merged(name: str) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held[name]])
            counts = np.concatenate([c for _, c in held[name]])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[starts], np.add.reduceat(counts, starts)

        def handed(name: str) -> pa.RecordBatch:
            keys, counts = merged(name)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())],
                names=["language", "gram", "n"],
            )

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(value)
                if not len(found):
                    continue
                held.setdefault(name, []).append(counted(found))
                sizes[name] = sizes.get(name, 0) + len(held[name][-1][0])
                if sizes[name] > _HELD:
                    held[name] = [merged(name)]
                    sizes[name] = len(held[name][0][0])
                    if sizes[name] > _HELD // 2:
                        yield handed(name)
                        held[name], sizes[name] = [], 0
        for name in held:
            if held[name]:
                yield handed(name)

    rows = df.select(language.cast("string").alias("language"), text.alias("text")).where("language is not null and text is not null")
    counts = rows.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    ).where(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for name, gram, _ in sorted(ranked.select("language", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        found.setdefault(name, []).append(gram)
    return {name: np.array(keys, np.int64) for name, keys in found.items()}


class Judge:
    """Compares texts with the profiles of all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        self._keys = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self._ranks = np.full((len(self._keys) + 1, len(self.names)), -1, np.int32)
        for column, name in enumerate(self.names):
            self._ranks[np.searchsorted(self._keys, profiles[name]), column] = np.arange(len(profiles[name]))

    def distances(self, text: str | None) -> np.ndarray | None:
        """The mean out-of-place distance to each language, 0 to 1; None without letters."""
        own = profile(text, self.size)
        if not len(own) or not self.names:
            return None
        at = np.searchsorted(self._keys, own)
        at[at == len(self._keys)] = 0
        at[self._keys[at] != own] = len(self._keys)
        ranks = self._ranks[at]
        moved = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        return np.where(ranks < 0, self.size, np.minimum(moved, self.size)).mean(axis=0) / self.size

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and its share of closeness among all languages."""
        far = self.distances(text)
        if far is None:
            return UNDETERMINED, 0.0
        best = int(np.argmin(far))
        close = np.exp(-20 * (far - far[best]))
        return self.names[best], float(1 / close.sum())


def identify(
    df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", row_id: str = "doc_id", size: int = PROFILE
) -> DataFrame:
    """One row per input row: the id, `lang_pred` and `score` (0 to 1)."""
    sent = df.sparkSession.sparkContext.broadcast(profiles)
    judges: list[Judge] = []

    def row(key, value):
        if not judges:
            judges.append(Judge(sent.value, size))
        return key, *judges[0].judge(value)

    out = map_rows(
        df, [F.col(row_id), F.col(text)], row, "row_id, lang_pred string, score double",
        pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]),
    )
    return out.select(F.col("row_id").cast(df.schema[row_id].dataType).alias(row_id), "lang_pred", "score")
