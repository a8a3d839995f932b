"""Operator 9: quality scores from random Fourier features, ridge regression and calibration.

Each text becomes a few statistics. ``cos(W z + b)`` with fixed random ``W`` approximates a Gaussian
kernel over the standardised statistics (Rahimi and Recht 2007). Each partition of the labelled rows
sums its part of the normal equations, so only matrices of the feature width move; the driver
solves one ridge system. An isotonic fit (pool adjacent violators) on a fold the ridge has not seen
turns the ridge score into a probability.

All labelled rows of the training folds are used. What reaches the driver is bounded by the
feature width times ``PARTIALS`` and by ``BINS``.

Defined results: a null text is the empty text, which has statistics and a score like any other;
equal texts get equal scores; rows with a null label or id are not learned from; a repeated id
in ``labels`` counts once with its mean label; of different texts under one id that with the least
statistics is learned from; without labels, or with only one class, every
score is the rate of class 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.llm.tables import FOLDS, stored
from seqtables.llm.words import SPACED, WordHasher, as_bytes

WIDTH = 300
GAMMA = 0.02
RIDGE = 1.0
SEED = 9
# Partial sums of the normal equations, and bins of scores for the isotonic fit.
PARTIALS = 16
BINS = 1000
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "blanks", "lines",
    "ends", "commas", "pipes", "marks", "rare_marks", "wide", "distinct_words", "top_word",
    "repeated_pairs", "distinct_pairs", "same_as_before", "shout_words", "glued_marks",
)
KINDS = np.zeros(256, dtype=np.uint8)
for _byte in range(256):
    _char = chr(_byte)
    KINDS[_byte] = (
        0 if _byte >= 128
        else 1 if _char.islower()
        else 2 if _char.isupper()
        else 3 if _char.isdigit()
        else 4 if _char == "\n"
        else 5 if _char.isspace()
        else 6 if _char in ".?!"
        else 7 if _char in ",;:'\"-()"
        else 8 if _char == "|"
        else 9
    )


def top_share(sorted_hashes: np.ndarray) -> tuple[float, float]:
    """Shares of distinct values and of the most frequent value."""
    n = len(sorted_hashes)
    if n == 0:
        return 1.0, 0.0
    first = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1])))
    runs = np.diff(np.concatenate((first, [n])))
    return len(first) / n, float(runs.max()) / n


def statistics(text: str | None, words: np.ndarray) -> list[float]:
    """Numbers that describe a text; ``words`` are the hashes of its words."""
    raw = np.frombuffer(as_bytes(text), dtype=np.uint8)
    n, m = len(raw), len(words)
    kinds = KINDS[raw]
    count = np.bincount(kinds, minlength=10).astype(float)
    share = count / max(1, n)
    distinct, top = top_share(np.sort(words))
    pairs = words[:-1] * np.uint64(3) + words[1:]
    distinct_pairs, top_pair = top_share(np.sort(pairs))
    same = float((words[1:] == words[:-1]).mean()) if m > 1 else 0.0
    # Marks right after a letter, two marks in a row: signs of junk appended to words.
    marks = kinds >= 6
    doubled = float((marks[1:] & marks[:-1]).sum()) / max(1, m)
    letters = count[0] + count[1] + count[2]
    return [
        np.log1p(n), np.log1p(m), n / max(1, m), letters / max(1, n),
        count[2] / max(1.0, letters), share[3], share[5], count[4] / max(1, m),
        count[6] / max(1, m), count[7] / max(1, m), count[8] / max(1, m), float(marks.sum()) / max(1, m),
        count[9] / max(1, m), share[0], distinct, top,
        top_pair, distinct_pairs, same, float(count[2] > 0.5 * letters), doubled,
    ]


def text_statistics(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, stats)``: one pass over the whole texts, narrow rows out."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACED)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [statistics(t, w) for t, w in zip(texts, hasher.texts(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["row_id", "stats"]
            )

    rows = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    return rows.mapInArrow(describe, f"row_id {rows.schema['row_id'].dataType.simpleString()}, stats array<double>")


@dataclass
class KernelRidge:
    """Fitted model: small arrays that travel with the task."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    seed: int = SEED
    gamma: float = GAMMA

    def raw(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.mean) / self.scale
        return fourier(z, len(self.weights) - 1, self.gamma, self.seed) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def fourier(z: np.ndarray, width: int, gamma: float, seed: int) -> np.ndarray:
    """Random Fourier features of the Gaussian kernel ``exp(-gamma |x - y|^2)`` and a constant."""
    draw = np.random.default_rng(seed)
    w = draw.normal(scale=np.sqrt(2 * gamma), size=(z.shape[1], width))
    b = draw.uniform(0, 2 * np.pi, size=width)
    phi = np.sqrt(2.0 / width) * np.cos(np.clip(z, -8, 8) @ w + b)
    return np.hstack([phi, np.ones((len(z), 1))])


def batch_stats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten()).reshape(len(column), -1)


def pool_adjacent(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray):
    """Isotonic fit of weighted means, as knots and values for interpolation."""
    blocks: list[list[float]] = []
    for s, y, n in zip(scores, ones, counts):
        blocks.append([y, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y1, n1, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + n1, blocks[-1][2], hi]
    knots = [k for b in blocks for k in (b[2], b[3])]
    values = [v for b in blocks for v in (b[0] / b[1],) * 2]
    return np.array(knots), np.array(values)


def fit(stats: DataFrame, labels: DataFrame, row_id: str, label: str, learn: Column) -> KernelRidge:
    """Fits on the rows where ``learn`` (over the id column ``row_id``) is true."""
    spark = stats.sparkSession
    marks = (
        labels.select(F.col(row_id).alias("row_id"), F.col(label).cast("double").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("row_id").isNotNull() & learn)
        .groupBy("row_id")
        .agg(F.avg("y").alias("y"))
    )
    fold = F.crc32(F.col("row_id").cast("string").cast("binary")) % FOLDS
    train = stored(
        stats.join(marks, "row_id").select("stats", "y", (fold == 1).alias("calibrate")),
        "quality-train",
    )
    width = len(STATISTICS)
    spread = train.select(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("rate"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(width)],
    ).first()
    rate = 0.5 if spread["rate"] is None else spread["rate"]
    if spread["n"] == 0 or rate in (0.0, 1.0):
        flat = np.array([rate])
        zero = np.zeros(width)
        return KernelRidge(zero, zero + 1, np.zeros(WIDTH + 1), np.zeros(1), flat)
    mean = np.array([spread[f"m{i}"] for i in range(width)])
    scale = np.array([spread[f"s{i}"] for i in range(width)])
    scale = np.where(scale > 1e-9, scale, 1.0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = WIDTH + 1
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            phi = fourier((batch_stats(batch, "stats") - mean) / scale, WIDTH, GAMMA, SEED)
            y = np.asarray(batch.column(1))
            gram += phi.T @ phi
            right += phi.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array([gram.ravel()], pa.list_(pa.float64())), pa.array([right], pa.list_(pa.float64()))],
            ["gram", "right"],
        )

    learned = train.filter(~F.col("calibrate")).select("stats", "y")
    sums = learned.repartition(PARTIALS).mapInArrow(partial, "gram array<double>, right array<double>")
    gram, right = np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros(WIDTH + 1)
    for row in sums.toLocalIterator():
        gram += np.array(row["gram"]).reshape(WIDTH + 1, WIDTH + 1)
        right += np.array(row["right"])
    penalty = np.full(WIDTH + 1, RIDGE)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(gram + np.diag(penalty), right)
    model = KernelRidge(mean, scale, weights, np.zeros(1), np.zeros(1))
    # Bins of the calibration scores, by value: their number bounds what the driver sees.
    scored = scored_rows(train.filter("calibrate"), model, raw=True)
    binned = (
        scored.groupBy(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "raw")) * (BINS / 3)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.avg("raw").alias("at"))
        .orderBy("bin")
        .collect()
    )
    if not binned:
        return KernelRidge(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    # Half a row of the prior rate on each side keeps the ends off 0 and 1.
    n = np.array([r["n"] for r in binned], dtype=float)
    ones = np.array([r["ones"] for r in binned], dtype=float)
    knots, values = pool_adjacent(np.array([r["at"] for r in binned]), ones, n)
    return KernelRidge(mean, scale, weights, knots, np.clip(values, 0.0, 1.0))


def scored_rows(rows: DataFrame, model: KernelRidge, raw: bool = False) -> DataFrame:
    """``rows`` with ``stats`` replaced by ``score``, or by the uncalibrated ``raw``."""
    kept = [c for c in rows.columns if c != "stats"]
    name = "raw" if raw else "score"
    schema = rows.select(*kept, F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = batch_stats(batch, "stats")
            values = model.raw(stats) if raw else model.score(stats)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(values)],
                [*kept, name],
            )

    return rows.mapInArrow(run, schema)


def one_per_id(stats: DataFrame) -> DataFrame:
    """One row for each id: of texts that share it, the one with the least statistics."""
    return stats.groupBy("row_id").agg(F.min("stats").alias("stats"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, row_id: str, text: str, label: str, learn: Column
) -> DataFrame:
    """``(row_id, score)`` for every row of ``docs``; equal ids stay separate rows."""
    stats = stored(text_statistics(docs, row_id, text), "quality-stats")
    model = fit(one_per_id(stats), labels, row_id, label, learn)
    return scored_rows(stats, model)


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    row_id: str,
    text: str,
    label: str,
    learn: Column,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns.

    The texts are described once for the fit and once to be judged where they lie, so no text is
    shuffled.
    """
    stats = stored(text_statistics(docs, row_id, text), "quality-stats")
    model = fit(one_per_id(stats), labels, row_id, label, learn)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACED)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            rows = [statistics(t, w) for t, w in zip(texts, hasher.texts(texts))]
            stats = np.array(rows, dtype=float).reshape(len(rows), len(STATISTICS))
            yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
