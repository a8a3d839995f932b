"""Row-local score expressions: probabilities, decisions, ranked results, cell losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.common import bind


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def double_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def probabilities(logits: Column, temperatures: Column | None = None) -> Column:
    """Sigmoid of the logits divided by the class temperature; unequal lengths are an error."""
    if temperatures is None:
        return F.transform(logits, sigmoid)
    checked = F.when(F.size(logits) == F.size(temperatures), logits).otherwise(
        F.raise_error(F.lit("logits and temperatures differ in length"))
    )
    return F.zip_with(checked, temperatures, lambda z, t: sigmoid(z / t))


def at_least(score: Column, bound: Column) -> Column:
    """``score >= bound`` where NaN is below every bound, not above as in Spark's order."""
    return F.nanvl(score.cast("double"), F.lit(float("-inf"))) >= bound


def binarize(probs: Column, threshold: float | Column = P.THRESHOLD) -> Column:
    """0/1 per class with >=; the threshold is one number or an array per class. NaN is 0."""
    if isinstance(threshold, Column):
        return F.zip_with(probs, threshold, lambda p, t: at_least(p, t).cast("int"))
    return F.transform(probs, lambda p: at_least(p, F.lit(float(threshold))).cast("int"))


def rank_predictions(
    probs: Column,
    labels: Column,
    threshold: float | Column = P.THRESHOLD,
    top_k: int = P.TOP_K,
) -> Column:
    """Top classes at or above their threshold by rounded confidence; none -> the best class."""
    if not isinstance(threshold, Column):
        threshold = F.transform(probs, lambda _: F.lit(float(threshold)))
    cells = F.transform(
        F.arrays_zip(probs.alias("p"), labels.alias("location"), threshold.alias("t")),
        lambda c, i: F.struct(
            (-F.round(c["p"], 4)).alias("neg"),
            i.alias("pos"),
            c["location"].alias("location"),
            F.round(c["p"], 4).alias("confidence"),
            (c["p"] >= c["t"]).alias("keep"),
        ),
    )
    best = F.array_position(probs, F.array_max(probs)).cast("int")

    def choose(all_cells: Column) -> Column:
        passing = F.slice(F.array_sort(F.filter(all_cells, lambda c: c["keep"])), 1, top_k)
        return F.when(F.size(passing) > 0, passing).otherwise(F.slice(all_cells, best, 1))

    return F.transform(
        bind(cells, choose),
        lambda c: F.struct(c["location"].alias("location"), c["confidence"].alias("confidence"))
    )


def bce_cell(z: Column, y: Column) -> Column:
    """Numerically stable binary cross-entropy of one cell."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal_cell(z: Column, y: Column, gamma: float = 2.0) -> Column:
    p = sigmoid(z)
    p_true = y * p + (F.lit(1.0) - y) * (F.lit(1.0) - p)
    return F.pow(F.lit(1.0) - p_true, F.lit(float(gamma))) * bce_cell(z, y)


def weighted_sum(values: Column, weights: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(
        F.zip_with(values, weights, lambda v, w: v.cast("double") * w),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def hierarchical_row(probs: Column, y: Column, distances: Sequence[Sequence[float]]) -> Column:
    """Mean over the classes of p(1-y) times the mean distance to the true classes."""
    n_true = F.greatest(F.aggregate(y, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    matrix = F.array(*[double_array(row) for row in distances])
    cells = F.transform(
        F.arrays_zip(probs.alias("p"), y.alias("y"), matrix.alias("d")),
        lambda c: c["p"] * (F.lit(1.0) - c["y"]) * weighted_sum(y, c["d"]) / n_true,
    )
    return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(probs)
