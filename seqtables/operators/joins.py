"""Joins that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.session import materialize

# A dimension is broadcast only after counting at most this many (narrow) rows.
BROADCAST_ROWS = 200_000
# Keys with more fact rows than this are looked up apart; there are at most rows/HOT_ROWS of them.
HOT_ROWS = 1_000_000


def fits_broadcast(dim: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``limit + 1`` rows; call it on stored or cheap frames."""
    return dim.limit(limit + 1).count() <= limit


def keyed_lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    how: str = "inner",
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join facts to a dimension with at most one row per key (``inner`` or ``left``).

    A dimension of counted small size is broadcast. A larger one is shuffled, except for hot
    keys: their dimension rows, at most ``rows / hot_rows`` many, are broadcast to the hot fact
    rows, so no task receives a whole hot group.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dim, broadcast_rows):
        return facts.join(F.broadcast(dim), keys, how)
    hot = materialize(
        facts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys)
    )
    if hot.isEmpty():
        return facts.join(dim, keys, how)
    if not fits_broadcast(hot, broadcast_rows):
        # Far beyond any real skew; adaptive skew handling splits the partitions instead.
        return facts.join(dim, keys, how)
    hot_dim = dim.join(F.broadcast(hot), keys, "left_semi")
    cold = facts.join(F.broadcast(hot), keys, "left_anti").join(dim, keys, how)
    warm = facts.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(hot_dim), keys, how)
    return cold.unionByName(warm)


def attach_clusters(df: DataFrame, clusters: DataFrame, key: str = "accession", **limits) -> DataFrame:
    """Add ``cluster_id`` by key; rows without a cluster are left out."""
    return keyed_lookup(df, clusters.select(key, "cluster_id"), key, "inner", **limits)


def unclustered(df: DataFrame, clusters: DataFrame, key: str = "accession") -> DataFrame:
    """The rows :func:`attach_clusters` leaves out."""
    return df.join(clusters.select(key), key, "left_anti")


def assign_split(df: DataFrame, cluster_split: DataFrame, **limits) -> DataFrame:
    """Add ``split`` from a ``(cluster_id, split)`` table."""
    return keyed_lookup(df, cluster_split.select("cluster_id", "split"), "cluster_id", **limits)


def align_scored(predictions: DataFrame, targets: DataFrame, key: str = "id") -> DataFrame:
    """Pair predictions and truth by id."""
    return predictions.join(targets, key, "inner")


def union_sources(frames: list[DataFrame]) -> tuple[DataFrame, list[int]]:
    """Append all sources; returns the rows and the positions of the empty ones.

    No rows at all is an error.
    """
    if not frames:
        raise ValueError("No data downloaded")
    empty = [i for i, f in enumerate(frames) if f.isEmpty()]
    if len(empty) == len(frames):
        raise ValueError("No data downloaded")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), empty
