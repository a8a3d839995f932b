"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the distinct hashes of its words, word pairs and skip pairs (one word left
out), and of the first few bytes of its words, so that an inflected word is known by its stem. FTRL-proximal (McMahan et al. 2013) gives every coordinate its own rate and, by the L1 term,
exact zeros, so the model is a short sorted list of hashes and weights that is broadcast to score
all texts. Shards of the labelled rows run FTRL on their own; their states are averaged by feature
and broadcast as the start of the next round (iterative parameter mixing, McDonald et al. 2010).

Bounds, all parameters: at most about ``MAX_LABELLED`` labelled rows are learned from (by hash of the
id; the corpus is scored whole), a feature must occur in ``MIN_DOCS`` texts of a shard, and at most
``MAX_WEIGHTS`` weights, the largest, are kept.

Defined results: a null text is the empty text and gets the score of the bias alone; equal texts get
equal scores; rows with a null label or id are not learned from; a repeated id in ``labels`` counts
as toxic if any of its rows does, and a repeated id in the documents is learned from once, with the
least of its texts; without labelled rows every score is 0.5; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.llm.tables import stored
from seqtables.llm.words import ALNUM, WordHasher, mix

MAX_LABELLED = 24_000
SHARD_ROWS = 2_000
ROUNDS = 4
MIN_DOCS = 4
MAX_WEIGHTS = 200_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
HEADS = (4, 5, 6, 7, 8)
THRESHOLD = 0.5


def features(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of words, word heads, pairs and skip pairs, sorted."""
    words = hashes[0]
    pairs = mix(words[:-1] + mix(words[1:] + np.uint64(1)))
    skips = mix(words[:-2] + mix(words[2:] + np.uint64(2)))
    return np.unique(np.concatenate((hashes.ravel(), pairs, skips)))


@dataclass
class SparseWeights:
    """Sorted feature hashes with their weights, and the bias."""

    keys: np.ndarray
    values: np.ndarray
    bias: float

    def logit(self, hashes: np.ndarray) -> float:
        if len(self.keys) == 0:
            return self.bias
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.bias + float(self.values[at[self.keys[at] == hashes]].sum())


def ftrl_pass(
    rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, order: np.ndarray
) -> None:
    """One pass of FTRL-proximal over rows of feature numbers; ``z`` and ``n`` are updated."""
    for i in order:
        at = rows[i]
        zi, ni = z[at], n[at]
        rate = (BETA + np.sqrt(ni)) / ALPHA
        w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / (rate + L2), 0.0)
        # The bias is the last number of a row and takes no L1.
        w[-1] = -zi[-1] / (rate[-1] + L2)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - labels[i]
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[at] = zi + g - sigma * w
        n[at] = ni + g * g


def shard_state(
    texts: list, labels: np.ndarray, start: tuple[np.ndarray, np.ndarray, np.ndarray], seed: int
) -> pd.DataFrame:
    """FTRL states of the features of one shard's texts after a pass from a common start."""
    hasher = WordHasher(ALNUM, HEADS)
    rows = [features(w) for w in hasher.texts(texts)]
    seen, count = np.unique(np.concatenate(rows), return_counts=True)
    seen = seen[count >= MIN_DOCS]
    bias = len(seen)
    keys, z0, n0 = start
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    if len(keys):
        # The bias is stored under the largest key.
        z[bias], n[bias] = z0[-1], n0[-1]
        at = np.minimum(np.searchsorted(keys, seen), len(keys) - 1)
        same = keys[at] == seen
        z[:bias][same], n[:bias][same] = z0[at[same]], n0[at[same]]
    coded = []
    for row in rows:
        at = np.minimum(np.searchsorted(seen, row), max(0, bias - 1))
        known = at[seen[at] == row] if bias else at[:0]
        coded.append(np.concatenate((known, [bias])))
    order = np.random.default_rng(seed).permutation(len(coded))
    ftrl_pass(coded, labels, z, n, order)
    keep = np.concatenate((np.abs(z[:bias]) > L1 / 2, [True]))
    hashes = np.concatenate((seen, [np.uint64(2**64 - 1)]))
    return pd.DataFrame(
        {"key": hashes[keep].view(np.int64), "z": z[keep], "n": n[keep]}
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, row_id: str, text: str, label: str, learn: Column, most: int
) -> tuple[DataFrame, int]:
    """``(row_id, text, y, shard)`` of about ``most`` labelled rows, and the number of shards.

    The chosen ids are bounded by ``most``, so they are broadcast and no text of any other row moves.
    The sample is stored, so the rounds read it and not the corpus; an id counts once, with the least
    of its texts.
    """
    marks = (
        labels.select(F.col(row_id).alias("row_id"), F.col(label).cast("double").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("row_id").isNotNull() & learn)
        .groupBy("row_id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.pmod(F.xxhash64("row_id", F.lit("toxic")), F.lit(1 << 30)))
    )
    total = marks.count()
    if total > most:
        marks = marks.filter(F.col("h") < int((1 << 30) * most / total))
    shards = -(-min(total, most) // SHARD_ROWS) or 1
    chosen = marks.select("row_id", "y", (F.col("h") % shards).cast("int").alias("shard"))
    rows = docs.select(F.col(row_id).alias("row_id"), F.coalesce(text, F.lit("")).alias("text"))
    known = rows.join(F.broadcast(chosen), "row_id")
    one = known.groupBy("row_id", "y", "shard").agg(F.min("text").alias("text"))
    return stored(one, "toxicity-sample"), shards


def shard_trainer(start, seed: int):
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id")
        return shard_state(rows["text"].tolist(), rows["y"].to_numpy(), start.value, seed)

    return train


def fit(sample: DataFrame, shards: int, most: int = MAX_WEIGHTS) -> SparseWeights:
    spark = sample.sparkSession
    empty = np.empty(0)
    start = (np.empty(0, dtype=np.uint64), empty, empty)
    for number in range(ROUNDS):
        train = shard_trainer(spark.sparkContext.broadcast(start), number)
        states = sample.groupBy("shard").applyInPandas(train, "key long, z double, n double")
        # A feature that a shard dropped counts there as zero: the sum is over all shards.
        mixed = (
            states.groupBy("key")
            .agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n"))
            .orderBy(F.abs("z").desc(), "key")
            .limit(most)
            .toPandas()
        )
        keys = mixed["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        start = (keys[order], mixed["z"].to_numpy()[order], mixed["n"].to_numpy()[order])
    return weights(*start)


def weights(keys: np.ndarray, z: np.ndarray, n: np.ndarray) -> SparseWeights:
    """The sparse model of an FTRL state whose last entry is the bias."""
    if len(keys) == 0:
        return SparseWeights(keys, z, 0.0)
    rate = (BETA + np.sqrt(n)) / ALPHA
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / (rate + L2), 0.0)
    kept = np.flatnonzero(w[:-1])
    return SparseWeights(keys[kept], w[kept], float(-z[-1] / (rate[-1] + L2)))


def score_texts(docs: DataFrame, row_id: str, text: str, model: SparseWeights) -> DataFrame:
    """``(row_id, score)``: a row-local pass over the whole texts."""
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ALNUM, HEADS)
        for batch in batches:
            words = hasher.texts(batch.column(1).to_pylist())
            logits = np.array([sent.value.logit(features(w)) for w in words], dtype=float)
            scores = 1.0 / (1.0 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["row_id", "score"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id {kind}, score double")


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    row_id: str,
    text: str,
    label: str,
    learn: Column,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``(row_id, score)`` for every row of ``docs``."""
    sample = labelled_sample(docs, labels, row_id, text, label, learn, max_labelled)
    return score_texts(docs, row_id, text, fit(*sample))
