"""Operator 8: document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if, of the hashes of its inner s-mers, the least is the
first or the last one (Edgar 2021). The choice depends on the k-mer alone, so an edit disturbs only
the anchors it touches and equal passages give equal anchors wherever they stand. A fingerprint
holds the ``SIZE`` anchors with the smallest hashes (a uniform sample of the distinct anchors of
the whole text) with the position of each one's first occurrence.

Two fingerprints are compared by hash and by place: of the smallest ``SIZE`` hashes of both
together, those held by both count if they can be chained in the same order in both texts (longest
increasing run of positions), so shuffled passages do not pass for copies. Likeness is the chained
share, 0 to 1.

Defined results: null and empty texts have the empty fingerprint; two empty fingerprints have
likeness 1, an empty and another one 0; a text shorter than k is one anchor of its own, and so is a
longer one without a closed syncmer, so only null and empty texts are empty; equal texts have equal
fingerprints; keys of another type than integers are refused with a ``TypeError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.llm.tables import integer_ids, parts
from seqtables.llm.words import mix

K, S = 12, 6
SIZE = 64
# Code points hashed at a time; blocks overlap by K - 1, so no k-mer is lost.
BLOCK = 1 << 18
MULTIPLIER = np.uint64(0x2545F4914F6CDD1D)


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` numbers, doubling the width covered in each step."""
    done, span = codes, 1
    power = MULTIPLIER
    acc, covered = None, 0
    with np.errstate(over="ignore"):
        while True:
            if width & span:
                if acc is None:
                    acc, covered = done, span
                else:
                    n = len(codes) - covered - span + 1
                    acc = acc[:n] * power + done[covered : covered + n]
                    covered += span
            if covered == width:
                return mix(acc)
            n = len(done) - span
            done = done[:n] * power + done[span : span + n]
            power = power * power
            span *= 2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    span = 1
    out = values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def closed_syncmers(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of one block of code points."""
    inner = rolling(codes, s)
    inside = k - s + 1
    low = least(inner, inside)
    n = len(low)
    at = np.flatnonzero((inner[:n] == low) | (inner[inside - 1 : inside - 1 + n] == low))
    # A k-mer is known by its edges: two windows of s numbers and the ones between.
    whole = rolling(codes, k)
    return at, whole[at]


def anchors(text: str, k: int = K, s: int = S, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` smallest distinct anchor hashes, ascending, and their first positions."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(codes) < k:
        return rolling(codes.astype(np.uint64), len(codes)), np.zeros(1, np.int64)
    best, place = np.empty(0, np.uint64), np.empty(0, np.int64)
    for lo in range(0, len(codes) - k + 1, BLOCK):
        at, found = closed_syncmers(codes[lo : lo + BLOCK + k - 1].astype(np.uint64), k, s)
        if len(found) > 4 * size:
            # Repeats make the cut deeper than needed, so it is repeated until enough are distinct.
            take = 4 * size
            while take < len(found):
                near = found <= np.partition(found, take)[take]
                if len(np.unique(found[near])) >= size:
                    at, found = at[near], found[near]
                    break
                take *= 4
        both = np.concatenate((best, found))
        where = np.concatenate((place, at + lo))
        best, first = np.unique(both, return_index=True)
        best, place = best[:size], where[first[:size]]
    if len(best) == 0:
        # Closed syncmers are certain from 2k - s - 1 code points on, so this text is a short one.
        return rolling(codes.astype(np.uint64), len(codes)), np.zeros(1, np.int64)
    return best, place


def as_text(mark: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join(f"{h:016x}@{p}" for h, p in zip(mark[0].tolist(), mark[1].tolist()))


def chain(places: np.ndarray) -> int:
    """Length of the longest increasing run."""
    tails: list[int] = []
    for p in places.tolist():
        lo = int(np.searchsorted(tails, p)) if tails else 0
        tails[lo : lo + 1] = [p]
    return len(tails)


def likeness(a: tuple, b: tuple, size: int = SIZE) -> float:
    """Share of the smallest hashes of both that are held by both in the same order."""
    if len(a[0]) == 0 or len(b[0]) == 0:
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:size]
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = shared <= union[-1]
    i, j = i[inside], j[inside]
    if len(i) == 0:
        return 0.0
    order = np.argsort(a[1][i], kind="stable")
    return chain(b[1][j][order]) / len(union)


def fingerprints(df: DataFrame, texts: list[str], pairs: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` without the columns ``texts``, with a fingerprint ``fp_<column>`` for each of them
    and a likeness for each ``(column, column, name)`` of ``pairs``.

    Row-local: a text is fingerprinted once where neighbouring rows or columns hold it again.
    """
    kept = [c for c in df.columns if c not in texts]
    schema = df.select(
        *kept,
        *[F.lit("").alias(f"fp_{c}") for c in texts],
        *[F.lit(0.0).alias(name) for *_, name in pairs],
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[str, tuple] = {}

        def mark(text: str | None) -> tuple:
            text = text or ""
            found = recent.pop(text, None) or anchors(text)
            recent[text] = found
            while len(recent) > 2 * len(texts):
                del recent[next(iter(recent))]
            return found

        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in [*kept, *texts]}
            prints: dict[str, list] = {c: [] for c in texts}
            likes: dict[str, list] = {name: [] for *_, name in pairs}
            for row in range(batch.num_rows):
                marks = {c: mark(column[c][row].as_py()) for c in texts}
                for c in texts:
                    prints[c].append(as_text(marks[c]))
                for a, b, name in pairs:
                    likes[name].append(likeness(marks[a], marks[b]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[column[c] for c in kept],
                    *[pa.array(prints[c], pa.string()) for c in texts],
                    *[pa.array(likes[name], pa.float64()) for *_, name in pairs],
                ],
                schema=pa.schema(
                    [pa.field(c, column[c].type) for c in kept]
                    + [pa.field(f"fp_{c}", pa.string()) for c in texts]
                    + [pa.field(name, pa.float64()) for *_, name in pairs]
                ),
            )

    return df.mapInArrow(run, schema)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, next_text)``: the next row by ``key``; after the last row comes the first.

    Keys fall into ranges between quantiles that are keys of the table, so the first row of a range
    is known: it is dealt to its own range and, as a tail, to the one before. One shuffle of the
    rows, no total sort. Null keys come first, ties are ordered by text.
    """
    spark = docs.sparkSession
    rank = F.coalesce(integer_ids(docs, key).cast("double"), F.lit(float("-inf")))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), rank.alias("_rank"))
    n = 8 * parts(spark)
    keys = rows.filter(F.col("_rank") > float("-inf"))
    cuts = keys.approxQuantile("_rank", [i / n for i in range(1, n)], 1 / (4 * n))
    lowest = rows.agg(F.min("_rank").alias("lo")).first()["lo"]
    starts = sorted({lowest, *cuts} - {None})
    if len(starts) > 1:
        split = Bucketizer(
            splits=[float("-inf"), *starts[1:], float("inf")], inputCol="_rank", outputCol="_range"
        )
        dealt = split.transform(rows).withColumn("_range", F.col("_range").cast("int"))
    else:
        dealt = rows.withColumn("_range", F.lit(0))
    # As many rows as ranges: bounded by the number of partitions.
    firsts = spark.createDataFrame([(c,) for c in starts], "_start double")
    last = max(0, len(starts) - 1)
    before = F.when(F.col("_range") == 0, F.lit(last)).otherwise(F.col("_range") - 1)
    own = F.struct(F.col("_range").alias("to"), F.lit(False).alias("tail"))
    tail = F.struct(before.alias("to"), F.lit(True).alias("tail"))
    placed = dealt.join(F.broadcast(firsts), F.col("_rank") == F.col("_start"), "left").select(
        "key",
        "text",
        F.explode(F.when(F.col("_start").isNull(), F.array(own)).otherwise(F.array(own, tail))).alias("_at"),
    )
    placed = placed.select("key", "text", "_at.to", "_at.tail")
    order = Window.partitionBy("to").orderBy("tail", F.col("key").asc_nulls_first(), "text")
    return (
        placed.withColumn("next_text", F.lead("text").over(order))
        .filter(~F.col("tail"))
        .select("key", "text", "next_text")
    )


def edited_by_next(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many first ones of another text."""
    size = F.length(text)
    half = F.floor(size / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), size - half), F.substr(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses."""
    pairs = with_next(docs, key, text).select(
        F.col("key"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("next_text", F.lit("")).alias("next"),
    )
    edited = pairs.withColumn("edited", edited_by_next(F.col("text"), F.col("next"))).select(
        "key",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "text",
        "edited",
        "next",
    )
    likes = [("text", "edited", "near_edited"), ("text", "next", "near_next")]
    return fingerprints(edited, ["text", "edited", "next"], likes)
