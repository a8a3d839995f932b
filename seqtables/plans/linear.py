"""Logistic regression of all classes at once.

Every class has its own coefficients and weights, and the classes are fitted side by side: one pass over
the rows sums the losses and gradients of all classes that are not done, and L-BFGS takes a step for
each. The objective of a class is ``sum of w * log loss + |coefficients| ** 2 / (2 c)``; the intercept is
not penalised. A fit ends when no part of a class's gradient, per unit of weight, exceeds ``tol``;
``gradient_norms`` gives that certificate for any model, by a plan of its own.

Sums of tasks meet in the order of their numbers, so a fit repeats on the same partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.plans.boosting import dense
from seqtables.session import stored_table

# Steps remembered, and bytes of partial sums that may go to the driver without a stage that adds them.
MEMORY = 10
DIRECT_BYTES = 4_000_000


@dataclass
class LinearModel:
    coef: np.ndarray
    intercept: float


def linear_logits(models: Sequence[LinearModel], features: Column) -> Column:
    """Array of the log-odds of each model."""
    weight = np.stack([m.coef for m in models], axis=1)
    shift = np.array([m.intercept for m in models])

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = dense(column)
            scores = x @ weight + shift if len(x) else np.empty((0, len(shift)))
            cuts = np.arange(0, scores.size + 1, len(shift), dtype=np.int32)
            yield pa.ListArray.from_arrays(cuts, pa.array(scores.ravel()))

    return score(features.cast("array<double>"))


@dataclass
class Descent:
    """L-BFGS of one class with backtracking, fed one loss and gradient at a time."""

    point: np.ndarray
    tol: float
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    moves: list = field(default_factory=list)
    done: bool = False
    steps: int = 0

    def asks(self) -> np.ndarray:
        """The point whose loss and gradient are needed next."""
        return self.point if self.direction is None else self.point + self.step * self.direction

    def take(self, loss: float, gradient: np.ndarray) -> None:
        if self.direction is not None:
            slope = float(self.gradient @ self.direction)
            if loss > self.loss + 1e-4 * self.step * slope:
                self.step /= 2
                # Beyond this the loss is flat to rounding.
                self.done = self.step < 1e-10
                return
            s, y = self.step * self.direction, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.moves = [*self.moves, (s, y)][-MEMORY:]
            self.point = self.point + s
            self.steps += 1
        self.loss, self.gradient = loss, gradient
        self.done = float(np.abs(gradient).max()) <= self.tol
        self.direction, self.step = -self.turned(), 1.0
        if self.steps == 0:
            self.step = min(1.0, 1.0 / max(1e-12, float(np.linalg.norm(gradient))))

    def turned(self) -> np.ndarray:
        """The gradient times the remembered inverse curvature."""
        q, scale = self.gradient.copy(), []
        for s, y in reversed(self.moves):
            a = (s @ q) / (s @ y)
            q -= a * y
            scale.append(a)
        if self.moves:
            s, y = self.moves[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.moves, reversed(scale)):
            q += s * (a - (y @ q) / (s @ y))
        return q


def log_loss(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted loss and its derivative by the margin."""
    loss = float((w * (np.logaddexp(0, margin) - y * margin)).sum())
    return loss, w * (1 / (1 + np.exp(-margin)) - y)


def summed_losses(rows: DataFrame, points: dict[int, np.ndarray], weights: dict) -> dict[int, np.ndarray]:
    """For each class ``[loss, gradient by coefficient, gradient by intercept]``, unpenalised."""
    order = sorted(points)
    stacked = np.stack([points[c] for c in order], axis=1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((len(order), len(stacked) + 1)), -1
        for batch in batches:
            x = dense(batch.column(0))
            if len(x) == 0:
                continue
            truth = dense(batch.column(1))
            part = batch.column(2)[0].as_py()
            margins = x @ stacked[:-1] + stacked[-1]
            for i, c in enumerate(order):
                y = np.nan_to_num(truth[:, c])
                w = np.where(y == 1, *weights[c])
                loss, slope = log_loss(margins[:, i], y, w)
                total[i] += np.concatenate(([loss], x.T @ slope, [slope.sum()]))
        if part >= 0:
            sums = pa.array([r.tobytes() for r in total], pa.binary())
            ids = pa.array(order, pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array([part] * len(order), pa.int32()), sums], ["c", "part", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found[c] = found.get(c, 0) + np.frombuffer(blob)
        columns = [pa.array(list(found), pa.int32()), pa.array([0] * len(found), pa.int32())]
        blobs = pa.array([v.tobytes() for v in found.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([*columns, blobs], ["c", "part", "sums"])

    schema = "c int, part int, sums binary"
    partial = rows.withColumn("part", F.spark_partition_id()).mapInArrow(add, schema)
    if rows.rdd.getNumPartitions() * stacked.size * 8 > DIRECT_BYTES:
        partial = partial.repartition("c").sortWithinPartitions("c", "part").mapInArrow(meet, schema)
    out: dict[int, np.ndarray] = {}
    for row in sorted(partial.collect(), key=lambda r: (r["c"], r["part"])):
        out[row["c"]] = out.get(row["c"], 0) + np.frombuffer(row["sums"])
    return out


def fit_linear(
    train: DataFrame,
    weights: dict[int, tuple[float, float]],
    c: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-6,
    features: str = "features",
    y: str = "y",
) -> dict[int, LinearModel]:
    """A model for each class in ``weights``, which has the weights of its positives and negatives."""
    pair = train.select(
        F.col(features).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")
    )
    rows = stored_table(pair, "linear-rows")
    size = rows.agg(F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    fits = {i: Descent(np.zeros(size["width"] + 1), tol * size["n"]) for i in weights}
    for _ in range(2 * max_iter):
        ask = {i: f.asks() for i, f in fits.items() if not f.done and f.steps < max_iter}
        if not ask:
            break
        for i, sums in summed_losses(rows, ask, weights).items():
            coef = np.append(ask[i][:-1], 0.0)
            fits[i].take(sums[0] + coef @ coef / (2 * c), sums[1:] + coef / c)
    return {i: LinearModel(f.point[:-1], float(f.point[-1])) for i, f in fits.items()}


def gradient_norms(
    train: DataFrame, models: dict[int, LinearModel], weights: dict[int, tuple[float, float]], c: float = 1.0,
    features: str = "features", y: str = "y",
) -> DataFrame:
    """``(label_idx, gradient)``: the largest part of each class's gradient per row, by DataFrame sums."""
    spark = train.sparkSession
    order = sorted(models)
    schema = "label_idx int, coef array<double>, intercept double, heavy double, light double"
    known = [
        (i, [*map(float, models[i].coef)], models[i].intercept, *map(float, weights[i])) for i in order
    ]
    table = F.broadcast(spark.createDataFrame(known, schema))
    cells = train.select(F.col(features).alias("x"), F.posexplode(F.col(y)).alias("label_idx", "truth"))
    cells = cells.join(table, "label_idx")
    product = F.aggregate(
        F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    p = 1 / (1 + F.exp(-(product + F.col("intercept"))))
    slope = F.when(F.col("truth") == 1, F.col("heavy")).otherwise(F.col("light")) * (p - F.col("truth"))
    parts = cells.select("label_idx", "coef", slope.alias("slope"), F.posexplode(F.concat("x", F.array(F.lit(1.0)))).alias("j", "v"))
    sums = parts.groupBy("label_idx", "j").agg(
        F.sum(F.col("slope") * F.col("v")).alias("g"), F.coalesce(F.first(F.get("coef", F.col("j"))), F.lit(0.0)).alias("w"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.groupBy("label_idx").agg(F.max(F.abs(F.col("g") + F.col("w") / c) / F.col("n")).alias("gradient"))


def save_linear(spark: SparkSession, models: dict[int, LinearModel], path: str) -> None:
    """One row a class below ``path``."""
    rows = [(i, [*map(float, m.coef)], float(m.intercept)) for i, m in models.items()]
    schema = "label_idx int, coef array<double>, intercept double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> dict[int, LinearModel]:
    return {r["label_idx"]: LinearModel(np.array(r["coef"]), r["intercept"]) for r in spark.read.parquet(path).collect()}
