"""Per-class decision parameters: temperatures and thresholds."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.scores import at_least, bce_cell, binarize, double_array, probabilities, sigmoid
from seqtables.operators.losses import to_long
from seqtables.session import materialize, stored_table


def threshold_candidates(n: int = 19, low: float = 0.05, high: float = 0.95) -> list[float]:
    if n < 2:
        raise ValueError("at least two threshold candidates are needed")
    return [round(low + i * (high - low) / (n - 1), 12) for i in range(n)]


def threshold_sweep(
    scored: DataFrame,
    candidates: Sequence[float] | None = None,
    fallback: float = P.THRESHOLD,
    probs: str = "probs",
    y: str = "y",
) -> DataFrame:
    """``(label_idx, threshold, f1)``: best F1 per class, the lowest threshold wins ties.

    One pass: each cell falls into one bin between candidates and only bin counts are shuffled.
    """
    cuts = threshold_candidates() if candidates is None else list(candidates)
    cells = scored.select(
        F.col(y).alias("_ys"), F.posexplode(probs).alias("label_idx", "p")
    ).withColumn("y", F.get(F.col("_ys"), F.col("label_idx")))
    passed = sum(at_least(F.col("p"), F.lit(c)).cast("int") for c in cuts)
    counts = (
        cells.withColumn("_bin", passed)
        .groupBy("label_idx", "_bin")
        .agg(F.sum(F.col("y").cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    )
    # From here on the table has at most classes x (candidates + 1) rows.
    per_cut = (
        counts.select(
            "label_idx", "_pos", "_n", F.explode(F.sequence(F.lit(0), "_bin")).alias("_cut")
        )
        .groupBy("label_idx", "_cut")
        .agg(F.sum("_pos").alias("tp"), F.sum("_n").alias("predicted"))
    )
    total = F.max(F.when(F.col("_cut") == 0, F.col("tp"))).over(Window.partitionBy("label_idx"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(total + F.col("predicted"), F.lit(0)), F.lit(0.0))
    scored_cuts = per_cut.withColumn("_total", total).withColumn("f1", f1)
    best = scored_cuts.groupBy("label_idx").agg(
        F.max("_total").alias("_total"),
        F.max(
            F.when(F.col("_cut") > 0, F.struct(F.col("f1"), (-F.col("_cut")).alias("neg")))
        ).alias("_best"),
    )
    chosen = F.when(F.coalesce(F.col("_best.f1"), F.lit(0.0)) > 0, -F.col("_best.neg")).otherwise(1)
    has = F.col("_total") > 0
    return best.select(
        "label_idx",
        F.when(has, F.element_at(double_array(cuts), chosen.cast("int")))
        .otherwise(F.lit(float(fallback)))
        .alias("threshold"),
        F.when(has, F.coalesce(F.col("_best.f1"), F.lit(0.0))).alias("f1"),
    )


def _losses(z: Column, y: Column, temps: Sequence[Column]) -> Column:
    return F.array(
        *[
            F.struct(F.avg(bce_cell(z / t, y)).alias("loss"), F.lit(i).alias("i"))
            for i, t in enumerate(temps)
        ]
    )


def fit_temperatures(
    scored: DataFrame,
    grid: Sequence[float] = P.TEMPERATURE_GRID,
    rounds: int = 30,
    fallback: float = 1.0,
    tolerance: float = 1e-9,
) -> DataFrame:
    """``(label_idx, temperature)`` that minimises the BCE per class.

    A coarse grid picks a bracket. The loss is convex in b = 1/T, so every round is one safeguarded
    Newton step on b: a pass over the cells that sums two derivatives per class. Only one row per
    class is shuffled; cells are never multiplied by candidates. The input is computed once, its
    logits and labels are stored for the passes. Rounds end when no class moves by more than
    ``tolerance``; if ``rounds`` do not suffice, a warning says so.
    """
    grid = [float(t) for t in grid]
    cells = to_long(stored_table(scored.select("logits", "y"), "calibration"))
    z, y = F.col("z"), F.col("y")
    values = double_array(grid)
    best = F.array_min("_losses")["i"] + 1
    state = (
        cells.groupBy("label_idx")
        .agg(_losses(z, y, [F.lit(t) for t in grid]).alias("_losses"), F.sum("y").alias("_pos"))
        .select(
            "label_idx",
            (F.col("_pos") > 0).alias("_has"),
            (1 / F.element_at(values, best)).alias("_b"),
            (1 / F.element_at(values, F.least(best + 1, F.lit(len(grid))))).alias("_min"),
            (1 / F.element_at(values, F.greatest(best - 1, F.lit(1)))).alias("_max"),
        )
        .select("*", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"))
    )
    b, lo, hi = F.col("_b"), F.col("_lo"), F.col("_hi")
    state = materialize(state)
    names, moves = state.columns, None
    for _ in range(rounds):
        # One row per class on the right-hand side: the length of the logit array bounds it.
        p = sigmoid(b * z)
        sums = (
            cells.join(F.broadcast(state), "label_idx")
            .groupBy(*names)
            .agg(F.sum(z * (p - y)).alias("_g"), F.sum(z * z * p * (1 - p)).alias("_h"))
        )
        rising = F.col("_g") > 0
        moved = sums.withColumns(
            {"_lo": F.when(rising, lo).otherwise(b), "_hi": F.when(rising, b).otherwise(hi)}
        ).withColumn("_next", b - F.col("_g") / F.nullif(F.col("_h"), F.lit(0.0)))
        step, middle = F.col("_next"), (lo + hi) / 2
        found = (
            F.when(step.isNull(), b)
            .when(step <= F.col("_min"), F.col("_min"))
            .when(step >= F.col("_max"), F.col("_max"))
            .when((step < lo) | (step > hi), middle)
            .otherwise(step)
        )
        after = materialize(
            moved.withColumn("_move", F.abs(found - b)).withColumn("_b", found).select(*names, "_move")
        )
        moves = after.agg(F.coalesce(F.max("_move"), F.lit(0.0)).alias("m")).first()["m"]
        state = after.select(*names)
        if moves <= tolerance:
            break
    if moves is None or moves > tolerance:
        warnings.warn(f"temperatures still move by {moves} after {rounds} rounds", stacklevel=2)
    return state.select(
        "label_idx",
        F.when(F.col("_has"), 1 / b).otherwise(F.lit(float(fallback))).alias("temperature"),
    )


def params_array(table: DataFrame, value: str, default: float, n_classes: int) -> Column:
    """A per-class parameter table as one array column ordered by class index.

    The value comes from a scalar subquery over at most ``n_classes`` rows.
    """
    entries = table.filter(F.col("label_idx").between(0, n_classes - 1)).agg(
        F.map_from_entries(F.collect_list(F.struct("label_idx", value))).alias("m")
    )
    lookup = entries.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_classes - 1)),
            lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(float(default))),
        ).alias("a")
    )
    return lookup.scalar()


def apply_class_params(
    scored: DataFrame,
    n_classes: int,
    thresholds: DataFrame | None = None,
    temperatures: DataFrame | None = None,
    threshold: float = P.THRESHOLD,
) -> DataFrame:
    """Add ``probs`` (calibrated), ``class_thresholds`` and ``preds``; defaults fill gaps."""
    temps = None if temperatures is None else params_array(temperatures, "temperature", 1.0, n_classes)
    cuts = (
        double_array([threshold] * n_classes)
        if thresholds is None
        else params_array(thresholds, "threshold", threshold, n_classes)
    )
    rows = scored.withColumn("class_thresholds", cuts)
    if temps is None:
        rows = rows.withColumn("probs", probabilities(F.col("logits")))
    else:
        # Subqueries may not stand inside a lambda, so the array is a column first.
        rows = rows.withColumn("_temps", temps)
        rows = rows.withColumn("probs", probabilities(F.col("logits"), F.col("_temps"))).drop(
            "_temps"
        )
    return rows.withColumn("preds", binarize(F.col("probs"), F.col("class_thresholds")))


def calibrate(val: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Temperatures on the validation logits, then thresholds on the calibrated scores."""
    temperatures = materialize(fit_temperatures(val))
    n_classes = temperatures.count()
    calibrated = apply_class_params(val, n_classes, temperatures=temperatures)
    return temperatures, materialize(threshold_sweep(calibrated))
