"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Tokens are words, then one end for each text. The model predicts the class of
the next token from the three before it: the classes are the most frequent
tokens (`SHORTLIST`, the end among them) and one for all the rest. A context is
the sum of its tokens' vectors, weighted by position; its product with the
class vectors, normalised over all classes, gives the class's probability. A
token of the rest has its class's probability times its share of the rest,
(c + 1) / (N_rest + V_rest + 1), which leaves one share for unknown tokens; so
the probabilities of all tokens sum to one.

Counts cover all training texts: each task counts, Spark sums, and the table of
counts stays distributed. Frequent tokens (`HEAD` at most, by a threshold on the
count that a histogram yields) and the end are broadcast; the others, each too rare to make
a hot key, are looked up by a join of a text's remaining tokens with the table.
Training is one pass over all windows of all training texts, each task starting
alike; parameters are averaged by how often each was moved.

Cases: a null or empty text is its end alone; null ids count as training; ties
in frequency go by token; without training texts every token is unknown, N and V
are 0 and all scores are 0; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BATCH_CHARS, stored

END = b"\n"
#: Classes, of which the last is the rest; tokens that are broadcast; buckets of other tokens in a context.
SHORTLIST, HEAD, BUCKETS = 256, 1 << 17, 2048
#: Tokens of context, length of a vector, noise samples for each batch, windows in a batch.
ORDER, WIDTH, NOISE, BATCH = 3, 16, 32, 1024
#: Share of the training windows that is trained on.
RATE = 1.0
_REST = SHORTLIST - 1
_START = SHORTLIST + BUCKETS
_HELD = 400_000
#: Windows scored at a time: their scores stay in the processor's cache.
BLOCK = 512


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def words(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """`tokens` by slices of the texts: the words of all texts of a slice, and how many each text has, without the ends."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BATCH_CHARS)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        # ASCII functions go by bytes, so the texts need not be valid UTF-8.
        part = texts.slice(start, stop - start).cast(pa.binary()).view(pa.string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(part))
        found = split.flatten()
        kept = pc.greater(pc.binary_length(found), 0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
        before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
        yield found.filter(kept).view(pa.binary()), np.diff(before[ends], prepend=0)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the texts in the first column; a token may come again after a bounded number of others."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by("token", use_threads=False).aggregate([("n", "sum")])
        return sums.select(["token", "n_sum"]).rename_columns(["token", "n"])

    parts: list[pa.Table] = []
    held = 0
    for batch in batches:
        for found, lengths in words(batch.column(0)):
            ends = pa.array([END], pa.binary()), pa.array([len(lengths)])
            for token, n in (pc.value_counts(found).flatten(), ends):
                parts.append(pa.table({"token": token, "n": n}))
                held += len(token)
            if held > 2 * _HELD:
                parts = [merged(parts)]
                held = len(parts[0])
                if held > _HELD:
                    yield from parts[0].to_batches()
                    parts, held = [], 0
    if parts:
        yield from merged(parts).to_batches()


def count(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all texts; each task hands on partial counts of a bounded number of tokens."""
    partial = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(partial_counts, "token binary, n long")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


def _bin(n: Column) -> Column:
    return F.floor(F.log2(n) * 16)


@dataclass
class Counts:
    """The table (token, n), its sums, and its most frequent tokens in order of frequency."""

    table: DataFrame
    n_tokens: int
    n_distinct: int
    head: dict[bytes, int]
    least_bin: int


def gather(texts: DataFrame, text: str = "text", head: int = HEAD) -> Counts:
    table = stored(count(texts, text), "counts")
    bins = table.groupBy(_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    least, taken = 1 << 20, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        taken += r["v"]
        if taken > head:
            break
        least = r["bin"]
    # The end has place 0 in every vocabulary and is never looked up in the table, so its count comes along at any threshold.
    rows = table.where((_bin(F.col("n")) >= least) | (F.col("token") == F.lit(END))).collect()
    ordered = sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))
    return Counts(table, sum(r["n"] for r in bins), sum(r["v"] for r in bins), dict(ordered), least)


class Vocabulary(dict):
    """Token to place in the head; other tokens to a negative number that tells their bucket."""

    def __init__(self, counts: dict[bytes, int]):
        ordered = [END, *(t for t in counts if t != END)]
        super().__init__(zip(ordered, range(len(ordered))))
        n = np.array([counts.get(t, 0) for t in ordered], np.int64)
        self.log_counts = np.log10(n + 1.0)
        self.known = n > 0
        self.n_listed = min(len(ordered), _REST)
        self.listed_total = int(n[: self.n_listed].sum())
        self.listed_distinct = int((n[: self.n_listed] > 0).sum())
        place = np.arange(len(ordered))
        self.classes = np.where(place < self.n_listed, place, _REST)
        buckets = np.array([SHORTLIST + crc32(t) % BUCKETS for t in ordered])
        self.contexts = np.where(place < self.n_listed, place, buckets)
        self.class_counts = np.bincount(self.classes, n, minlength=SHORTLIST)

    def __missing__(self, token: bytes) -> int:
        return -1 - crc32(token) % BUCKETS

    @cached_property
    def _listing(self) -> pa.Array:
        return pa.array(list(self)[1:], pa.binary())

    def places(self, found: list[bytes]) -> np.ndarray:
        return np.array([self[t] for t in found], np.int64)

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """By slices of the texts: how many tokens each text has, the places of all, and the tokens outside the head."""
        for found, lengths in words(texts):
            places = pc.fill_null(pc.index_in(found, value_set=self._listing), -1).to_numpy().astype(np.int64) + 1
            outside = places == 0
            others = found.filter(pa.array(outside)).to_pylist()
            places[outside] = [self.__missing__(t) for t in others]
            yield lengths + 1, np.insert(places, np.cumsum(lengths), self[END]), others

    def windows(self, places: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token and its contexts, the nearest first; of one text, or of texts of these lengths."""
        if lengths is None:
            lengths = np.array([len(places)])
        inside, listed = places >= 0, np.maximum(places, 0)
        at = np.arange(len(places)) + ORDER * np.repeat(np.arange(1, len(lengths) + 1), lengths)
        padded = np.full(len(places) + ORDER * len(lengths), _START)
        padded[at] = np.where(inside, self.contexts[listed], SHORTLIST - 1 - places)
        before = np.stack([padded[at - k] for k in range(1, ORDER + 1)], axis=1)
        return np.where(inside, self.classes[listed], _REST), before


def added(weighted: np.ndarray) -> np.ndarray:
    """The sum over the positions of a context; whole slices are faster than `sum` over so short an axis."""
    total = weighted[:, 0].copy()
    for k in range(1, weighted.shape[1]):
        total += weighted[:, k]
    return total


class Model:
    """Parameters: vectors of contexts (shared by the positions), position weights, class vectors and biases."""

    SHAPES = ((_START + 1, WIDTH), (ORDER, WIDTH), (SHORTLIST, WIDTH), (SHORTLIST,))

    def __init__(self, class_counts: np.ndarray):
        random = np.random.default_rng(11)
        share = (class_counts + 1.0) / (class_counts.sum() + SHORTLIST)
        self.noise = share
        self.parts = [
            random.normal(0, 0.1, self.SHAPES[0]).astype(np.float32), np.ones(self.SHAPES[1], np.float32),
            random.normal(0, 0.1, self.SHAPES[2]).astype(np.float32), np.log(share).astype(np.float32),
        ]

    def context(self, before: np.ndarray) -> np.ndarray:
        vectors, weights = self.parts[:2]
        return added(vectors.take(before, axis=0) * weights)

    def log10_class(self, classes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the classes.

        exp(score) is a product of one factor for each position, so the factors of all contexts are computed once and
        multiplied by window: no exp for each window and class. Few windows, or factors that a product might not hold,
        go by their scores.
        """
        vectors, weights, outputs, bias = self.parts
        if len(classes) < len(vectors):
            return self.log10_by_scores(classes, before)
        logs = [(vectors * weights[k]) @ outputs.T for k in range(ORDER)]
        logs[0] += bias
        if sum(float(np.abs(part).max()) for part in logs) > 80:
            return self.log10_by_scores(classes, before)
        factors = [np.exp(part) for part in logs]
        out, each = np.empty(len(classes)), np.ones(SHORTLIST, np.float32)
        for start in range(0, len(classes), BLOCK):
            part = slice(start, start + BLOCK)
            product = factors[0].take(before[part, 0], axis=0)
            for k in range(1, ORDER):
                product *= factors[k].take(before[part, k], axis=0)
            out[part] = product[np.arange(len(product)), classes[part]].astype(np.float64) / (product @ each)
        return np.log10(out)

    def log10_by_scores(self, classes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """`log10_class` by products of a block of contexts with all class vectors."""
        out = np.empty(len(classes))
        for start in range(0, len(classes), BLOCK):
            part = slice(start, start + BLOCK)
            scores = self.context(before[part]) @ self.parts[2].T
            scores += self.parts[3]
            own = scores[np.arange(len(scores)), classes[part]].astype(np.float64)
            if max(scores.max(), -scores.min()) > 60:
                shift = scores.max(axis=1, keepdims=True)
                total = np.log(np.exp(scores - shift).sum(axis=1)) + shift[:, 0]
            else:
                total = np.log(np.exp(scores, out=scores).sum(axis=1))
            out[part] = own - total
        return out / np.log(10)


class Trainer:
    """Noise-contrastive steps with per-row adaptive rates; remembers how often each parameter was moved."""

    def __init__(self, model: Model, seed: int = 5, rate: float = 0.15):
        self.model, self.random, self.rate = model, np.random.default_rng(seed), rate
        self.past = [np.full(p.shape[:1], 1.0, np.float32) for p in model.parts]
        self.moved = [np.zeros(p.shape[:1]) for p in model.parts]

    def step(self, classes: np.ndarray, before: np.ndarray) -> None:
        vectors, weights, outputs, bias = self.model.parts
        n = len(classes)
        noise = self.random.choice(SHORTLIST, NOISE, p=self.model.noise)
        log_noise = np.log(NOISE * self.model.noise).astype(np.float32)
        looked, right, wrong = vectors.take(before, axis=0), outputs.take(classes, axis=0), outputs[noise]
        context = added(looked * weights)
        own = (context * right).sum(axis=1) + bias[classes] - log_noise[classes]
        other = context @ wrong.T
        other += bias[noise]
        other -= log_noise[noise]
        up, down = 1 / (1 + np.exp(np.clip(own, -30, 30))), other
        np.clip(other, -30, 30, out=down)
        np.exp(np.negative(down, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        g_context = up[:, None] * right
        g_context += down @ wrong
        g_rows = np.empty((n + NOISE, WIDTH), np.float32)
        np.multiply(up[:, None], context, out=g_rows[:n])
        np.matmul(down.T, context, out=g_rows[n:])
        rows = _sorted(np.concatenate([classes, noise]))
        self._move(2, rows, g_rows.take(rows[0], axis=0), n)
        self._move(3, rows, np.concatenate([up, down.sum(axis=0)])[rows[0]], n)
        places = np.arange(ORDER)
        self._move(1, (places, places, places), (looked * g_context[:, None, :]).sum(axis=0), n)
        rows = _sorted(before.ravel())
        window, place = np.divmod(rows[0], ORDER)
        self._move(0, rows, g_context.take(window, axis=0) * weights.take(place, axis=0), 0)

    def _move(self, part: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], gradient: np.ndarray, windows: int) -> None:
        """Move the rows that `_sorted` found by their summed gradients, which come in its order."""
        order, starts, rows = found
        summed = np.add.reduceat(gradient, starts, axis=0)
        size = summed * summed if summed.ndim == 1 else (summed * summed).mean(axis=1)
        self.past[part][rows] += size
        pace = self.rate / np.sqrt(self.past[part][rows])
        self.model.parts[part][rows] += (pace if summed.ndim == 1 else pace[:, None]) * summed
        if windows:
            self.moved[part] += windows
        else:
            self.moved[part][rows] += np.diff(starts, append=len(order))


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts rows, where each distinct one starts in it, and the distinct rows; short integers sort by radix."""
    order = np.argsort(rows.astype(np.min_scalar_type(_START)), kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return order, starts, rows[starts]


def train(texts: DataFrame, vocabulary: Vocabulary, text: str = "text", rate: float = RATE) -> Model:
    """One pass over all texts; each task trains from the same start, and the results are averaged in Spark."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        model = Model(known.class_counts)
        trainer = Trainer(model)
        classes, before, held = [], [], 0
        for batch in batches:
            for lengths, places, _ in known.read(batch.column(0)):
                all_y, all_x = known.windows(places, lengths)
                ends = np.cumsum(lengths)
                for begin, end in zip((ends - lengths).tolist(), ends.tolist()):
                    chosen = trainer.random.random(end - begin) < rate
                    classes.append(all_y[begin:end][chosen])
                    before.append(all_x[begin:end][chosen])
                    held += len(classes[-1])
                    if held >= 16 * BATCH:
                        ys, xs = np.concatenate(classes), np.concatenate(before)
                        mixed = trainer.random.permutation(held)
                        for start in range(0, held, BATCH):
                            trainer.step(ys[mixed[start : start + BATCH]], xs[mixed[start : start + BATCH]])
                        classes, before, held = [], [], 0
        if held:
            trainer.step(np.concatenate(classes), np.concatenate(before))
        weights = np.concatenate([np.repeat(m, p[0].size) for m, p in zip(trainer.moved, model.parts)])
        values = np.concatenate([p.ravel() for p in model.parts]).astype(np.float64)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(values[at] * weights[at]), pa.array(weights[at])], names=["at", "value", "weight"]
        )

    moved = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "at int, value double, weight double")
    means = moved.groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
    model = Model(vocabulary.class_counts)
    flat = np.concatenate([p.ravel() for p in model.parts])
    if len(means):
        flat[means["at"].to_numpy()] = means["value"].to_numpy()
    sizes = np.cumsum([p.size for p in model.parts])[:-1]
    model.parts = [part.reshape(shape).astype(np.float32) for part, shape in zip(np.split(flat, sizes), Model.SHAPES)]
    return model


def score(
    df: DataFrame, held_out: Column, counts: Counts, vocabulary: Vocabulary, model: Model,
    text: str = "text", row_id: str = "doc_id",
) -> DataFrame:
    """One row per input row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    n_rest, v_rest = counts.n_tokens - vocabulary.listed_total, counts.n_distinct - vocabulary.listed_distinct
    log_all, log_rest = np.log10(counts.n_tokens + counts.n_distinct + 1), np.log10(n_rest + v_rest + 1)
    sent = df.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bilinear = sent.value
        for batch in batches:
            done = 0
            for lengths, places, others in known.read(batch.column(2)):
                classes, before = known.windows(places, lengths)
                starts = np.cumsum(lengths) - lengths
                inside, listed, rest = places >= 0, np.maximum(places, 0), classes == _REST
                logs = np.where(inside, known.log_counts[listed], 0.0)
                base = np.add.reduceat(logs, starts) - lengths * log_all
                modelled = np.add.reduceat(np.where(rest, logs, 0.0), starts)
                modelled -= np.add.reduceat(rest, starts, dtype=np.int64) * log_rest
                if counts_any:
                    modelled += np.add.reduceat(bilinear.log10_class(classes, before), starts)
                ends = np.cumsum(np.add.reduceat(~inside, starts, dtype=np.int64)).tolist()
                tails = [Counter(others[start:stop]) for start, stop in zip([0, *ends], ends)]
                columns = [
                    *(batch.column(k).slice(done, len(lengths)) for k in (0, 1)), lengths,
                    np.add.reduceat(inside & known.known[listed], starts, dtype=np.int64), base, modelled,
                    [list(t) for t in tails], [list(t.values()) for t in tails],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                done += len(lengths)

    counts_any = counts.n_tokens > 0
    kind = df.schema[row_id].dataType
    schema = pa.schema([
        ("row_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
        ("base", pa.float64()), ("modelled", pa.float64()), ("tail", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())),
    ])
    parts = df.select(F.col(row_id).alias("row_id"), held_out.alias("held"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, f"row_id {kind.simpleString()}, held_out boolean, n_tokens long, known long, base double, modelled double, "
        "tail array<binary>, times array<int>",
    )
    parts = stored(parts.withColumn("at", F.monotonically_increasing_id()), "scored")
    tail = parts.select("at", F.inline(F.arrays_zip(F.col("tail").alias("token"), F.col("times").alias("times"))))
    rare = counts.table.where(_bin(F.col("n")) < counts.least_bin)
    looked = tail.join(rare, "token").groupBy("at").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more")
    )
    more = F.coalesce("more", F.lit(0.0))
    return parts.join(looked, "at", "left").select(
        F.col("row_id").cast(df.schema[row_id].dataType).alias(row_id), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("modelled") + more).alias("score"),
    )


def score_corpus(df: DataFrame, held_out: Column, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, and score all rows."""
    training = df.where(~held_out)
    counts = gather(training, text)
    vocabulary = Vocabulary(counts.head)
    return score(df, held_out, counts, vocabulary, train(training, vocabulary, text), text, row_id)
