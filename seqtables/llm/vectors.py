"""Operator 13: near copies among vectors by random-hyperplane sign hashing in several tables.

Two vectors link when their cosine, in double precision, reaches ``threshold``.

1. Classes. Equal vectors collapse to one class with its number of rows (128-bit keys), so copies
   cost one row however many there are.
2. Sketches. Each of ``tables`` tables takes ``bits`` signs of random projections; two vectors at angle
   ``a`` share a table's signs with chance ``(1 - a / pi) ** bits``. ``bits`` follows the logarithm of
   the number of rows, which keeps the buckets of unrelated vectors small, and ``tables`` is then as
   large as keeps the chance to miss a pair right at the threshold below ``miss``; closer pairs are
   missed far less often. The rule is the same at every size.
3. Tiles. Buckets of one class go. The others are dealt into blocks of at most about ``BLOCK_ROWS``
   classes, and every two blocks of a bucket meet in one tile, so no group meets in one task. A tile
   multiplies its vectors, verifies the cosines and counts each linked pair in the first table that
   the two share only. It returns a number of links for each class and a star for each group of
   linked classes; pairs are never written.
4. Components over the stars, in steps stored in the shared folder.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths do not link; repeated rows are vectors of their own; a row with
a null id counts as a vector and a link, is never a component's id unless it stands alone (then the id
is null) and is not kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.llm.components import components, stars
from seqtables.llm.jaccard import small_or_shuffled
from seqtables.llm.tables import stored
from seqtables.llm.words import mix

THRESHOLD = 0.95
MISS = 0.002
SEED = 13
BLOCK_ROWS = 1_024
# Runs up to this size are compared by offset, all runs of a batch at once.
SMALL_RUN = 24
# Linked pairs whose sketches are compared at a time, and products computed at a time.
PAIRS = 1 << 16
# Cosines this close to the threshold are computed again without blocking.
CLOSE = 1e-9


def table_shape(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a table and number of tables."""
    bits = min(60, max(8, math.ceil(math.log2(max(rows, 1) + 1)) + 3))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows as doubles, divided by powers of two so that squares stay finite."""
    matrix = matrix.astype(np.float64)
    most = np.abs(matrix).max(axis=1, initial=0)
    return np.ldexp(matrix, -np.frexp(most)[1][:, None])


def planes(length: int, table: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, table, length)).standard_normal((length, bits))


def sketches(matrix: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One number of ``bits`` signs for each row and table."""
    weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    out = np.empty((len(matrix), tables), np.int64)
    for t in range(tables):
        out[:, t] = ((matrix @ planes(matrix.shape[1], t, bits, seed)) >= 0) @ weights
    return out


def list_matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and values of the lists of each length."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    first = np.concatenate(([0], np.cumsum(sizes)))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[first[at][:, None] + np.arange(size)]


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, row by row."""
    dots = np.einsum("ij,ij->i", u, v)
    return dots / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))


def linked_rows(
    vectors: np.ndarray, sketch: np.ndarray, bucket: np.ndarray, block: np.ndarray, table: np.ndarray,
    cross: np.ndarray, threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows ``(a, b)`` that link and share their first table here.

    Rows of a tile (``bucket``) are contiguous; where ``cross``, only rows of different blocks pair.
    """
    n = len(vectors)
    edge = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [n]))
    size = np.repeat(np.diff(edge), np.diff(edge))
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    found_a, found_b = [], []

    def verify(a: np.ndarray, b: np.ndarray) -> None:
        for lo in range(0, len(a), PAIRS):
            x, y = a[lo : lo + PAIRS], b[lo : lo + PAIRS]
            keep = (block[x] != block[y]) | ~cross[x]
            x, y = x[keep], y[keep]
            near = np.einsum("ij,ij->i", unit[x], unit[y])
            x, y, near = (z[near >= threshold - CLOSE] for z in (x, y, near))
            close = np.abs(near - threshold) < CLOSE
            near[close] = cosines(vectors[x[close]], vectors[y[close]])
            first = sketch[x] == sketch[y]
            keep = (near >= threshold) & (first.argmax(axis=1) == table[x]) & first.any(axis=1)
            found_a.append(x[keep])
            found_b.append(y[keep])

    for step in range(1, SMALL_RUN):
        a = np.flatnonzero((bucket[step:] == bucket[:-step]) & (size[step:] <= SMALL_RUN)) if step < n else []
        if len(a) == 0:
            break
        verify(a, a + step)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi - lo <= SMALL_RUN:
            continue
        # A cross tile multiplies one block by the other, any other one the upper half of itself.
        own = block[lo:hi] == block[lo]
        left = lo + (np.flatnonzero(own) if cross[lo] else np.arange(hi - lo))
        right = lo + (np.flatnonzero(~own) if cross[lo] else np.arange(hi - lo))
        for at in range(0, len(left), 256):
            x, y = np.nonzero(unit[left[at : at + 256]] @ unit[right].T >= threshold - CLOSE)
            x, y = left[at + x], right[y]
            if not cross[lo]:
                x, y = x[x < y], y[x < y]
            verify(x, y)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def tile_links(threshold: float):
    """Arrow function over rows sorted by tile: ``(cid, links)`` and star edges ``(a, b)``."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        column = {name: rows.column(name).combine_chunks() for name in rows.column_names}
        sketch = np.frombuffer(b"".join(column["sketch"].to_pylist()), np.int64).reshape(rows.num_rows, -1)
        for at, values in list_matrix(column["v"]):
            take = {k: np.asarray(column[k])[at] for k in ("bucket", "ti", "tj", "t", "block", "cid", "m")}
            # Sorted rows, so a change of any of the three numbers begins a tile.
            tile = np.concatenate(([0], np.cumsum(
                np.any([take[k][1:] != take[k][:-1] for k in ("bucket", "ti", "tj")], axis=0)
            )))
            a, b = linked_rows(
                scaled(values), sketch[at], tile, take["block"], take["t"], take["ti"] != take["tj"], threshold
            )
            links = np.bincount(a, take["m"][b], len(at)) + np.bincount(b, take["m"][a], len(at))
            some = np.flatnonzero(links)
            root = stars(a, b, len(at))
            leaf = np.flatnonzero(root != np.arange(len(at)))
            none = pa.nulls(max(len(some), len(leaf)), pa.int64())
            ids = take["cid"]
            counts = [pa.array(ids[some]), pa.array(links[some].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*counts, none[: len(some)], none[: len(some)]], OUT)
            edges = [pa.array(ids[leaf]), pa.array(ids[root[leaf]])]
            yield pa.RecordBatch.from_arrays([none[: len(leaf)], none[: len(leaf)], *edges], OUT)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last tile of a batch waits for the next batch."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([np.asarray(batch.column(k)) for k in ("bucket", "ti", "tj")])
            same = (keys == keys[:, -1:]).all(axis=0)
            last = batch.num_rows if not same[0] else 0
            if same[0] and waiting:
                before = waiting[-1].slice(waiting[-1].num_rows - 1)
                joined = all(before.column(k)[0].as_py() == keys[i, -1] for i, k in enumerate(("bucket", "ti", "tj")))
                if not joined:
                    yield from run(pa.Table.from_batches(waiting))
                    waiting = []
            if last:
                last = int(np.flatnonzero(~same)[-1]) + 1
                waiting.append(batch.slice(0, last))
                yield from run(pa.Table.from_batches(waiting))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield from run(pa.Table.from_batches(waiting))

    return tiles


OUT = ["cid", "links", "a", "b"]


def vector_classes(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """One stored row for each different vector: ``cid, k1, k2, m, least, v, sketch``."""
    grouped = rows.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("m"), F.min("row_id").alias("least"), F.first("v").alias("v")
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, tables), np.int64)
            for at, values in list_matrix(batch.column("v")):
                out[at] = sketches(scaled(values), bits, tables, seed)
            raw = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, "sketch"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema)
    named = grouped.mapInArrow(sketch, f"{kinds}, sketch binary")
    return stored(named.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")


def bucket_members(classes: DataFrame) -> DataFrame:
    """``(bucket, t, cid)`` for every class and table."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            marks = marks.reshape(batch.num_rows, -1).view(np.uint64)
            table = np.arange(marks.shape[1], dtype=np.uint64)
            length = np.asarray(batch.column(2)).astype(np.uint64)[:, None] << np.uint64(16)
            bucket = mix(marks + mix(table[None, :] + length))
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket.view(np.int64).ravel()),
                pa.array(np.tile(table.astype(np.int32), len(marks))),
                pa.array(np.repeat(np.asarray(batch.column(0)), marks.shape[1])),
            ], ["bucket", "t", "cid"])

    narrow = classes.select("cid", "sketch", F.size("v").alias("length"))
    return narrow.mapInArrow(explode, "bucket long, t int, cid long")


def near_vectors(
    vectors: DataFrame, row_id: str, vector: str, threshold: float = THRESHOLD, miss: float = MISS,
    seed: int = SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(row_id, n_links, component_id, kept)`` for every row."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    held = "array<float>" if kind == "float" else "array<double>"
    rows = vectors.select(F.col(row_id).alias("row_id"), F.col(vector).cast(held).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")))
    keyed = rows.select("row_id", "ok", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(seed), "v").alias("k2"))
    narrow = stored(keyed, "vector-keys")
    bits, tables = table_shape(narrow.filter("ok").count(), threshold, miss)
    good = rows.filter("ok").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(seed), "v")})
    classes = vector_classes(good, bits, tables, seed)

    members = bucket_members(classes)
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = members.join(small_or_shuffled(stored(counts, "vector-buckets")), "bucket")
    blocks = F.ceil(F.col("n") / block_rows)
    dealt = shared.withColumn("blocks", blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiled = dealt.select("bucket", "t", "cid", "block", other).select(
        "bucket", "t", "cid", "block",
        F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
    )
    # Each tile is dealt by all its numbers, so the blocks of a large bucket meet in many tasks.
    tile = ["bucket", "ti", "tj"]
    full = tiled.join(classes.select("cid", "m", "v", "sketch"), "cid")
    full = full.repartition(*tile).sortWithinPartitions(*tile)
    found = full.mapInArrow(tile_links(threshold), "cid long, links long, a long, b long")
    found = stored(found, "vector-links")

    sums = found.filter("cid IS NOT NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.filter("a IS NOT NULL").select("a", "b"), "a", "b")
    rooted = classes.select("cid", "k1", "k2", "m", "least").join(
        small_or_shuffled(stored(roots.withColumnRenamed("id", "cid"), "vector-roots")), "cid", "left"
    ).withColumn("root", F.coalesce("root", "cid"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").join(sums, "cid", "left").select(
        "k1", "k2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    named = small_or_shuffled(stored(named, "vector-results"))
    linked = narrow.filter("ok").join(named, ["k1", "k2"]).select("row_id", "n_links", "component_id")
    alone = narrow.filter("not ok").select(
        "row_id", F.lit(0).cast("long").alias("n_links"), F.col("row_id").alias("component_id")
    )
    kept = F.coalesce(F.col("row_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
