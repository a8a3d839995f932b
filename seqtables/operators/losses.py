"""Loss values of scored tables, computed cell by cell and combined before any shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.scores import (
    bce_cell,
    double_array,
    focal_cell,
    hierarchical_row,
    probabilities,
)


def to_long(scored: DataFrame, logits: str = "logits", y: str = "y", keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: ``(keep..., label_idx, z, y)``."""
    return scored.select(
        *keep, F.col(y).alias("_ys"), F.posexplode(logits).alias("label_idx", "z")
    ).select(
        *keep, "label_idx", "z", F.get(F.col("_ys"), F.col("label_idx")).cast("double").alias("y")
    )


def bce_by_class(
    scored: DataFrame, temperatures: Sequence[float] | None = None
) -> DataFrame:
    cells = to_long(scored)
    z = F.col("z")
    if temperatures is not None:
        z = z / F.element_at(double_array(temperatures), F.col("label_idx") + 1)
    return cells.groupBy("label_idx").agg(F.avg(bce_cell(z, F.col("y"))).alias("bce"))


def focal_loss(
    scored: DataFrame,
    gamma: float = 2.0,
    alpha: Sequence[float] | None = None,
    reduction: str = "mean",
) -> DataFrame:
    """Focal loss over all cells; ``none`` keeps one row per cell."""
    if reduction not in ("mean", "sum", "none"):
        raise ValueError(f"unknown reduction: {reduction}")
    cells = to_long(scored, keep=["id"] if reduction == "none" else [])
    loss = focal_cell(F.col("z"), F.col("y"), gamma)
    if alpha is not None:
        loss = loss * F.element_at(double_array(alpha), F.col("label_idx") + 1)
    if reduction == "none":
        return cells.select("id", "label_idx", loss.alias("focal"))
    combine = F.avg if reduction == "mean" else F.sum
    return cells.agg(combine(loss).alias("focal"))


def distance_rows(
    labels: Sequence[str],
    pairs: Mapping[tuple[str, str], float] | None = None,
    default: float = P.DEFAULT_DISTANCE,
) -> list[list[float]]:
    """Class distances as nested lists for use inside row expressions."""
    pairs = P.CLASS_DISTANCES if pairs is None else pairs
    rows = [
        [
            0.0 if a == b else float(pairs.get((a, b), pairs.get((b, a), default)))
            for b in labels
        ]
        for a in labels
    ]
    top = max((max(r) for r in rows), default=0.0)
    return [[v / top for v in r] for r in rows] if top > 0 else rows


def distance_matrix(
    vocabulary: DataFrame, pairs: DataFrame, default: float = P.DEFAULT_DISTANCE
) -> DataFrame:
    """``(a, b, dist)`` over a vocabulary frame; ``pairs`` holds one row per unordered pair.

    The class grid is built from one array of labels, so it grows with the classes only.
    """
    names = vocabulary.agg(F.array_sort(F.collect_list("label")).alias("l"))
    grid = names.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b"))
    forward = pairs.select("a", "b", F.col("dist").alias("_f"))
    backward = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("dist").alias("_r"))
    raw = grid.join(forward, ["a", "b"], "left").join(backward, ["a", "b"], "left")
    dist = F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(
        F.coalesce(F.col("_f").cast("double"), F.col("_r").cast("double"), F.lit(float(default)))
    )
    top = F.max("_d").over(Window.partitionBy())
    return raw.withColumn("_d", dist).select(
        "a", "b", F.when(top > 0, F.col("_d") / top).otherwise(F.col("_d")).alias("dist")
    )


def distance_pairs(spark, pairs: Mapping[tuple[str, str], float] | None = None) -> DataFrame:
    """The pair table as a frame."""
    pairs = P.CLASS_DISTANCES if pairs is None else pairs
    return spark.createDataFrame(
        [(a, b, float(d)) for (a, b), d in pairs.items()], "a string, b string, dist double"
    )


def hierarchical_penalty(scored: DataFrame, distances: Sequence[Sequence[float]]) -> DataFrame:
    row = hierarchical_row(probabilities(F.col("logits")), F.col("y"), distances)
    return scored.agg(F.avg(row).alias("hierarchical"))


def _row_mean(logits: Column, y: Column, cell) -> Column:
    values = F.zip_with(logits, y, cell)
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(logits)


def combined_loss(
    scored: DataFrame,
    distances: Sequence[Sequence[float]],
    gamma: float = 2.0,
    alpha: Sequence[float] | None = None,
    hierarchy_weight: float = 0.1,
    aux_weight: float = 0.2,
) -> DataFrame:
    """Focal + weighted hierarchical penalty (+ weighted auxiliary BCE), one pass over rows.

    Auxiliary terms are used when the frame has ``aux_logits`` and ``aux_y`` arrays.
    """
    z, y = F.col("logits"), F.col("y")
    scale = double_array(alpha) if alpha is not None else F.transform(z, lambda _: F.lit(1.0))
    focal_cells = F.transform(
        F.arrays_zip(z.alias("z"), y.alias("y"), scale.alias("a")),
        lambda c: focal_cell(c["z"], c["y"].cast("double"), gamma) * c["a"],
    )
    focal = F.aggregate(focal_cells, F.lit(0.0), lambda a, x: a + x) / F.size(z)
    terms = [
        F.avg(focal).alias("focal"),
        F.avg(hierarchical_row(probabilities(z), y, distances)).alias("hierarchical"),
    ]
    total = F.col("focal") + F.lit(hierarchy_weight) * F.col("hierarchical")
    if "aux_logits" in scored.columns:
        aux = _row_mean(
            F.col("aux_logits"), F.col("aux_y"), lambda a, b: bce_cell(a, b.cast("double"))
        )
        terms.append(F.avg(aux).alias("aux"))
        total = total + F.lit(aux_weight) * F.col("aux")
    return scored.agg(*terms).withColumn("loss", total)


__all__ = [
    "bce_by_class",
    "combined_loss",
    "distance_matrix",
    "distance_pairs",
    "distance_rows",
    "focal_loss",
    "hierarchical_penalty",
    "to_long",
]
