"""Secret scans with a trigram inverted index.

Each rule's pattern yields a Boolean query over trigrams. A task indexes its
texts segment by segment (an Arrow batch is a segment, as postings never need
to leave the task that has the texts), intersects the postings, and runs a
rule's pattern over its candidates only. Rules without a mandatory trigram run
over every text of the segment. Texts are not shuffled.

Cases: a null or empty text has no spans; overlapping spans of different kinds
are all reported; within a kind, matches are leftmost and do not overlap;
repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_CHARS
from .trigrams import Index, candidates, trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """A match counts if `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


# The kinds and their patterns, in the order in which spans at one place are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of hex digits is one match whatever its length, so asking for 24 in the pattern changes nothing.
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    # It begins a run of its characters: else each `eyJ` in a long run would be walked to the end.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"://[A-Za-z0-9._%+-]+:[^\s:/@]{3,}@[A-Za-z0-9]"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:int,end:int>>"


class Scanner:
    """Finds the spans of all rules in a segment of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self._patterns = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
        self._queries = [trigram_query(r.pattern) for r in rules]
        self._index = Index(set().union(*map(trigrams_of, self._queries)))

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        texts = [t or "" for t in texts]
        postings = self._index.postings([t.encode().lower() for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for order, (rule, pattern, query) in enumerate(zip(self.rules, self._patterns, self._queries)):
            for row in candidates(query, postings, len(texts)).tolist():
                for match in pattern.finditer(texts[row]):
                    if match.end(rule.group) - match.start(rule.group) >= rule.least:
                        found[row].append((match.start(), order, match.end()))
        return [[(self.rules[order].kind, start, end) for start, order, end in sorted(spans)] for spans in found]


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def _segments(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut so that their texts, at least one, stay within BATCH_CHARS."""
    for batch in batches:
        texts, start, chars = batch.column(at).to_pylist(), 0, 0
        for k, text in enumerate(texts):
            chars += len(text or "")
            if chars >= BATCH_CHARS or k == len(texts) - 1:
                yield batch.slice(start, k + 1 - start), texts[start : k + 1]
                start, chars = k + 1, 0


def find_secrets(df: DataFrame, text: str = "text", row_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id and `spans` (kind, start, end) in code points, end exclusive."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch, texts in _segments(batches, 1):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in row] for row in _scanner(rules).spans(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], names=["row_id", "spans"])

    narrow = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"row_id {df.schema[row_id].dataType.simpleString()}, spans {SPANS}").select(
        F.col("row_id").cast(df.schema[row_id].dataType).alias(row_id), "spans"
    )


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch covered by spans becomes one mark that names the first kind there."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `df` with every secret in `text` replaced by a mark; null stays null. A worker is sent the text alone."""

    @F.arrow_udf("string")
    def masked(column: pa.Array) -> pa.Array:
        found: list[str | None] = []
        for _, texts in _segments(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), 0):
            spans = _scanner(rules).spans(texts)
            found += [t if t is None or not s else mask(t, s) for t, s in zip(texts, spans)]
        return pa.array(found, pa.string())

    return df.withColumn(text, masked(F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
