"""Exact ranks without a single-partition sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.functions.keys import BUCKET_DIGITS, key_bucket
from seqtables.operators.joins import keyed_lookup
from seqtables.session import materialize


def _ranged(df: DataFrame, order: Sequence[Column | str], partitions: int | None) -> DataFrame:
    spread = (
        df.repartitionByRange(*order)
        if partitions is None
        else df.repartitionByRange(partitions, *order)
    )
    placed = spread.sortWithinPartitions(*order).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"),
    )
    # The range bounds are sampled, so the placed rows are stored before they are counted.
    return materialize(placed)


def global_row_number(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "row_idx",
    partitions: int | None = None,
) -> DataFrame:
    """Zero-based position in the total order; ``order`` must end in a unique column.

    Pass narrow frames: the rows are range-partitioned and stored once.
    """
    placed = _ranged(df, order, partitions)
    # One row per partition, so the running sum and the broadcast are bounded by their number.
    ends = placed.groupBy("_part").agg((F.max("_pos") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_pos")).alias(name)
    )


def grouped_row_number(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    name: str = "row_idx",
    partitions: int | None = None,
) -> DataFrame:
    """Zero-based position within each group, where one group may span many partitions."""
    placed = _ranged(df, [*groups, *order], partitions)
    runs = placed.groupBy("_part", *groups).agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = (
        Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = runs.select(
        "_part",
        *groups,
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return keyed_lookup(placed, materialize(shifts), ["_part", *groups]).select(
        *df.columns, (F.col("_pos") + F.col("_shift")).alias(name)
    )


def rank_cutoffs(
    keys: DataFrame,
    quotas: Callable[[Column], Sequence[Column]] | DataFrame,
    groups: Sequence[str] = (),
    key: str = "key",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Key values at the wanted ranks of every group: ``(groups..., n, cut_0, cut_1, ...)``.

    ``key`` starts with uniform hex digits and is unique. ``quotas(n)`` gives the ranks for a
    group of n rows, or a frame gives them as columns beside the groups; rank 0 gives a null cut. Only a histogram over the leading digits and the
    few bins that hold a wanted rank are shuffled, never the rows themselves.
    """
    groups = list(groups)
    binned = keys.select(*groups, key, key_bucket(F.col(key), digits).alias("_bin"))
    counts = binned.groupBy(*groups, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.select(
        *groups,
        "_bin",
        "_c",
        F.sum("_c").over(upto).alias("_hi"),
        F.sum("_c").over(whole).alias("n"),
    )
    if isinstance(quotas, DataFrame):
        wanted = [F.col(c) for c in quotas.columns if c not in groups]
        running = running.join(quotas, groups)
    else:
        wanted = quotas(F.col("n"))
    marks = F.array(
        *[
            F.struct(F.lit(i).alias("which"), r.cast("long").alias("rank"))
            for i, r in enumerate(wanted)
        ]
    )
    edges = materialize(
        running.select("*", F.explode(marks).alias("_m"))
        .filter(
            (F.col("_m.rank") > F.col("_hi") - F.col("_c")) & (F.col("_m.rank") <= F.col("_hi"))
            | (F.col("_hi") == F.col("n")) & (F.col("_m.rank") <= 0)
        )
        .select(
            *groups,
            "_bin",
            "n",
            F.col("_m.which").alias("_which"),
            F.when(F.col("_m.rank") > 0, F.col("_m.rank") - (F.col("_hi") - F.col("_c"))).alias(
                "_need"
            ),
        )
    )
    bins = edges.filter(F.col("_need").isNotNull()).groupBy(*groups, "_bin").agg(
        F.collect_list(F.struct("_which", "_need")).alias("_marks")
    )
    inside = Window.partitionBy(*groups, "_bin").orderBy(key)
    hits = (
        keyed_lookup(binned, materialize(bins), [*groups, "_bin"])
        .withColumn("_rn", F.row_number().over(inside))
        .select(*groups, key, "_rn", F.explode("_marks").alias("_m"))
        .filter(F.col("_rn") == F.col("_m._need"))
        .select(*groups, F.col("_m._which").alias("_which"), F.col(key).alias("_cut"))
    )
    sizes = edges.select(*groups, "n", F.lit(-1).alias("_which"), F.lit(None).cast("string").alias("_cut"))
    return (
        hits.select(*groups, F.lit(None).cast("long").alias("n"), "_which", "_cut")
        .unionByName(sizes)
        .groupBy(*groups)
        .agg(
            F.max("n").alias("n"),
            *[
                F.max(F.when(F.col("_which") == i, F.col("_cut"))).alias(f"cut_{i}")
                for i in range(len(wanted))
            ],
        )
    )
