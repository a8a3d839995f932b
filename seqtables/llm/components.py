"""Connected components of an edge table, stored after every half step.

Alternating large-star and small-star steps (Kiveris et al. 2014) on Parquet tables in the shared
folder. Each least neighbour is stored before it is joined back, so the join shuffles plain rows
and adaptive execution can split the partition of a node with very many neighbours.

Edges whose counted number fits one task (``TASK_EDGES``, 16 bytes each) are labelled there in one job
instead; the roots are the smallest ids of the components both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.llm.tables import stored


TASK_EDGES = 100_000


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row of the group of each of ``n`` rows under the links ``a, b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def label_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, root)`` from all edges ``(hi, lo)`` of a bounded table."""
    parts = [np.stack([np.asarray(c) for c in batch.columns]) for batch in batches]
    hi, lo = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
    ids, place = np.unique(np.concatenate((hi, lo)), return_inverse=True)
    root = ids[stars(place[: len(hi)], place[len(hi) :], len(ids))]
    leaf = root != ids
    yield pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(root[leaf])], ["id", "root"])


def ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    return (
        df.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )


def settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around roots: nobody has two roots and no root has one."""
    ends = edges.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(
        edges.select(F.col("lo").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(id, root)`` for every node that is not the smallest of its component."""
    current = stored(ordered(edges, a, b), "edges")
    if current.count() <= task_edges:
        return current.select("hi", "lo").coalesce(1).mapInArrow(label_edges, "id long, root long")
    while not settled(current):
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = stored(both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m")), "least")
        large = stored(ordered(both.filter("v > u").join(least, "u"), "v", "m"), "large-star")
        roots = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "roots")
        moved = large.join(roots, "hi").select(F.col("lo").alias("x"), "m")
        small = ordered(moved, "x", "m").unionByName(roots.select("hi", F.col("m").alias("lo")))
        current = stored(small.distinct(), "small-star")
    return current.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
