"""Training batches as tables: which row goes into which batch, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.keys import normal, order_key, permuted, stable_key, whole_below
from seqtables.operators.joins import keyed_lookup
from seqtables.operators.ranking import global_row_number, grouped_row_number


def length_bucket_batches(
    df: DataFrame,
    key: str,
    length: str,
    batch_size: int,
    jitter: float = 0.05,
    seed: int = P.SEED,
    epoch: int = 0,
    drop_last: bool = False,
    replicas: int = 1,
    shuffle: bool = True,
) -> DataFrame:
    """``(key, length, batch_id, replica, batch_order)`` with similar lengths in a batch.

    Rows are ordered by length plus seeded normal jitter and cut into runs of
    ``batch_size * replicas``; ``key`` must be unique and breaks ties.
    """
    if batch_size < 1 or replicas < 1:
        raise ValueError("batch_size and replicas must be positive")
    rows = df.select(key, length)
    sort = F.col(length).cast("double")
    if shuffle and jitter > 0:
        spread = df.agg((F.max(length) - F.min(length)).cast("double").alias("r")).scalar()
        scale = F.greatest(F.lit(1.0), spread * F.lit(jitter))
        noise = normal(stable_key(f"{seed}|{epoch}", F.col(key)))
        sort = F.round(sort + noise * scale, 6)
    ranked = global_row_number(rows.withColumn("_sort", sort), ["_sort", key], "_rank")
    n = ranked.count()
    if n == 0:
        raise ValueError("no rows to batch")
    run = batch_size * replicas
    full = n // run
    partial = n % run > 0 and not (drop_last or replicas > 1)
    n_batches = full + int(partial)
    placed = ranked if partial else ranked.filter(F.col("_rank") < full * run)
    placed = placed.select(
        key,
        length,
        F.col("_rank"),
        F.floor(F.col("_rank") / run).cast("long").alias("batch_id"),
        F.floor((F.col("_rank") % run) / batch_size).cast("long").alias("replica"),
    )
    if not shuffle:
        return placed.withColumn("batch_order", F.col("batch_id")).withColumnRenamed("_rank", "rank")
    ids = df.sparkSession.range(n_batches).select(
        F.col("id").alias("batch_id"),
        order_key(f"{seed}|{epoch}|batch", F.col("id")).alias("_key"),
    )
    order = global_row_number(ids, ["_key"], "batch_order").select("batch_id", "batch_order")
    return keyed_lookup(placed, order, "batch_id").select(
        key, length, F.col("_rank").alias("rank"), "batch_id", "replica", "batch_order"
    )


def padding_waste(batches: DataFrame, length: str, by: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Padded positions per batch."""
    waste = F.max(length) * F.count(F.lit(1)) - F.sum(length)
    return batches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), waste.cast("long").alias("padding")
    )


def balanced_batches(
    df: DataFrame,
    key: str,
    y: str,
    batch_size: int,
    n_batches: int | None = None,
    rare: float = 0.5,
    seed: int = P.SEED,
    epoch: int = 0,
) -> DataFrame:
    """``(batch_id, slot, key)``: one positive of every rare class, then a uniform fill.

    A class is rare when it has positives but fewer than ``rare * rows / classes``. The fill of
    a batch is the beginning of a permutation of all rows keyed by the batch, so batches are drawn
    independently and a batch has no repeats unless the pool is smaller than the batch.
    """
    if batch_size < 1:
        raise ValueError(f"batch_size must be >= 1, got {batch_size}")
    tag = f"{seed}|{epoch}"
    # One row per class.
    per_class = {
        r["c"]: (r["pos"], r["n"])
        for r in df.select(F.posexplode(y).alias("c", "v"))
        .groupBy("c")
        .agg(F.sum(F.col("v").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
        .collect()
    }
    if not per_class:
        raise ValueError("no rows to batch")
    n_rows = max(n for _, n in per_class.values())
    bound = n_rows / len(per_class) * rare
    rare_classes = [c for c in sorted(per_class) if 0 < per_class[c][0] < bound]
    total = n_batches if n_batches is not None else max(1, n_rows // batch_size)

    rows = df.select(key, y, order_key(tag, F.col(key)).alias("_key"))
    index = global_row_number(rows, ["_key"], "row_idx").select(key, y, "row_idx")
    batches = df.sparkSession.range(total).select(F.col("id").alias("batch_id"))
    none = F.array().cast("array<bigint>")
    if rare_classes:
        marked = F.array(
            *[F.when(F.get(F.col(y), F.lit(c)) == 1, F.lit(c)) for c in rare_classes]
        )
        positives = grouped_row_number(
            index.select("row_idx", F.explode(F.array_compact(marked)).alias("c")),
            ["c"],
            ["row_idx"],
            "pos_idx",
        )
        draws = F.array(
            *[
                F.struct(
                    F.lit(c).alias("c"),
                    whole_below(
                        stable_key(f"{tag}|pick|{c}", F.col("batch_id")), per_class[c][0]
                    ).alias("pos_idx"),
                )
                for c in rare_classes
            ]
        )
        picked = keyed_lookup(
            batches.select("batch_id", F.inline(draws)), positives, ["c", "pos_idx"]
        )
        by_batch = picked.groupBy("batch_id").agg(
            F.array_sort(F.collect_list(F.struct("c", "row_idx"))).alias("_p")
        )
        batches = by_batch.select(
            "batch_id",
            F.slice(
                F.array_distinct(F.transform("_p", lambda s: s["row_idx"])), 1, batch_size
            ).alias("_picks"),
        )
    else:
        batches = batches.withColumn("_picks", none)
    reach = min(batch_size + len(rare_classes), n_rows)
    places = F.transform(
        F.sequence(F.lit(0), F.lit(reach - 1)),
        lambda i: permuted(i, n_rows, f"{tag}|fill", F.col("batch_id")),
    )
    pool = F.filter(places, lambda r: ~F.array_contains(F.col("_picks"), r))
    missing = F.lit(batch_size) - F.size("_picks")
    repeat = F.transform(
        F.sequence(F.lit(1), missing),
        lambda i: F.get(
            F.col("_pool"),
            whole_below(
                stable_key(f"{tag}|repeat", F.col("batch_id"), i), F.size("_pool")
            ).cast("int"),
        ),
    )
    fill = (
        F.when((missing <= 0) | (F.size("_pool") == 0), none)
        .when(F.size("_pool") >= missing, F.slice("_pool", 1, F.greatest(missing, F.lit(0))))
        .otherwise(repeat)
    )
    slots = (
        batches.withColumn("_pool", pool)
        .select("batch_id", F.posexplode(F.concat("_picks", fill)).alias("slot", "row_idx"))
    )
    return keyed_lookup(slots, index.select("row_idx", key), "row_idx").select(
        "batch_id", "slot", key
    )


def pad_batches(
    df: DataFrame, batch: str = "batch_id", tokens: str = "ids", pad_id: int = 1
) -> DataFrame:
    """Right-pad token arrays to the longest of their batch; adds the attention ``mask``."""
    width = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    gap = F.col("_width") - F.size(tokens)

    def repeat(value: int, times: Column, kind: str) -> Column:
        return F.array_repeat(F.lit(value).cast(kind), times)

    element = df.schema[tokens].dataType.elementType.simpleString()
    return (
        df.withColumn("_width", width)
        .withColumn("mask", F.concat(repeat(1, F.size(tokens), "int"), repeat(0, gap, "int")))
        .withColumn(tokens, F.concat(F.col(tokens), repeat(pad_id, gap, element)))
        .drop("_width")
    )
