"""Token and chunk pooling by group, with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.functions.scores import double_array, weighted_sum
from seqtables.functions.sequences import chunk_sequence


def explode_chunks(
    df: DataFrame,
    sequence: str,
    window: int,
    overlap: int,
    min_chunk: int | None = None,
) -> DataFrame:
    """One row per chunk: the other columns plus ``chunk`` and ``chunk_sequence``."""
    return df.select(
        *[c for c in df.columns if c != sequence],
        F.posexplode(chunk_sequence(F.col(sequence), window, overlap, min_chunk)).alias(
            "chunk", "chunk_sequence"
        ),
    )


def _per_element(n: int, combine) -> Column:
    return F.array(*[combine(i) for i in range(n)])


def _weighted_sum(vec: Column, weight: Column) -> Column:
    """Sum of weighted vectors as one aggregate, whatever their width."""
    scaled = F.transform(vec, lambda x: x.cast("double") * weight)
    return vector_to_array(Summarizer.sum(array_to_vector(scaled)))


def aggregate_chunks(
    chunks: DataFrame,
    n_classes: int,
    strategy: str = "mean",
    key: str = "id",
    logits: str = "logits",
    weight: str | None = None,
) -> DataFrame:
    """``(key, logits)`` combined over the chunks of a sequence: mean, max or weighted."""
    z = F.col(logits)
    if strategy == "mean":
        value = _per_element(n_classes, lambda i: F.avg(F.get(z, F.lit(i))))
    elif strategy == "max":
        value = _per_element(n_classes, lambda i: F.max(F.get(z, F.lit(i))))
    elif strategy == "weighted":
        if weight is None:
            raise ValueError("strategy 'weighted' needs a weight column")
        w = F.col(weight)
        total = F.when(F.sum(w) > 0, F.sum(w)).otherwise(
            F.raise_error(F.lit("weights must sum to a positive number")).cast("double")
        )
        value = _per_element(n_classes, lambda i: F.sum(F.get(z, F.lit(i)) * w) / total)
    else:
        raise ValueError(f"unknown aggregation strategy: {strategy}")
    return chunks.groupBy(key).agg(value.alias(logits))


def pool_tokens(
    tokens: DataFrame,
    dim: int,
    how: str = "mean",
    key: str = "id",
    pos: str = "pos",
    mask: str = "mask",
    vec: str = "vec",
) -> DataFrame:
    """``(key, pooled)``: masked mean, position 0, or both side by side."""
    v, m = F.col(vec), F.col(mask).cast("double")
    count = F.greatest(F.sum(m), F.lit(1.0))
    first = F.max(F.when(F.col(pos) == 0, F.transform(v, lambda x: x.cast("double"))))
    sums = {"_sum": _weighted_sum(v, m), "_count": count, "_first": first}
    mean = F.transform("_sum", lambda x: x / F.col("_count"))
    if how == "mean":
        pooled = mean
        del sums["_first"]
    elif how == "cls":
        return tokens.filter(F.col(pos) == 0).select(
            key, F.transform(v, lambda x: x.cast("double")).alias("pooled")
        )
    elif how == "mean_cls":
        pooled = F.concat("_first", mean)
    else:
        raise ValueError(f"unknown pooling: {how}")
    summed = tokens.groupBy(key).agg(*[c.alias(n) for n, c in sums.items()])
    return summed.select(key, pooled.alias("pooled"))


def attention_pool(
    tokens: DataFrame,
    weights: Sequence[float],
    bias: float = 0.0,
    key: str = "id",
    mask: str = "mask",
    vec: str = "vec",
) -> DataFrame:
    """Softmax-weighted sum over unmasked positions of a linear score.

    A fully masked sequence gets equal weights. A group is one sequence, so it is bounded by the
    sequence length, and the sum reuses the partitioning of the window.
    """
    whole = Window.partitionBy(key)
    score = weighted_sum(F.col(vec), double_array(weights)) + F.lit(float(bias))
    scored = tokens.select(
        key, vec, F.when(F.col(mask) == 1, score).alias("_s")
    ).withColumn("_top", F.max("_s").over(whole))
    weight = F.when(F.col("_top").isNull(), F.lit(1.0)).otherwise(
        F.coalesce(F.exp(F.col("_s") - F.col("_top")), F.lit(0.0))
    )
    summed = (
        scored.withColumn("_w", weight)
        .groupBy(key)
        .agg(_weighted_sum(F.col(vec), F.col("_w")).alias("_sum"), F.sum("_w").alias("_all"))
    )
    return summed.select(key, F.transform("_sum", lambda x: x / F.col("_all")).alias("pooled"))
