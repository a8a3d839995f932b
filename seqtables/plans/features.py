"""A fitted stage that turns external feature columns into one array, with the training statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables.operators.scaling import fit_stats


class _FeatureParams(Params):
    properties = Param(
        Params._dummy(), "properties", "columns standardised with training statistics",
        TypeConverters.toListString,
    )
    tools = Param(
        Params._dummy(), "tools", "columns taken as they are; 0 where missing", TypeConverters.toListString
    )
    outputCol = Param(Params._dummy(), "outputCol", "name of the array", TypeConverters.toString)


class FeatureStage(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns mean and deviation of every property in one pass over the training rows."""

    def __init__(
        self, properties: Sequence[str] = (), tools: Sequence[str] = (), outputCol: str = "external"
    ):
        super().__init__()
        self._set(properties=list(properties), tools=list(tools), outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        names = self.getOrDefault("properties")
        stats = fit_stats(dataset, names).first().asDict() if names else {}
        return FeatureModel(
            names,
            self.getOrDefault("tools"),
            self.getOrDefault("outputCol"),
            [float(stats[f"{c}_mean"]) for c in names],
            [float(stats[f"{c}_std"]) for c in names],
        )


class FeatureModel(Model, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the array: properties by training mean and deviation, then the tools' columns.

    A property that is null, NaN or absent from the table counts as the training mean (0 after scaling);
    a tool's value that is missing, and the column of a tool that did not run, count 0. The width
    depends on the parameters alone.
    """

    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "training deviations", TypeConverters.toListFloat)

    def __init__(
        self,
        properties: Sequence[str] = (),
        tools: Sequence[str] = (),
        outputCol: str = "external",
        means: Sequence[float] = (),
        deviations: Sequence[float] = (),
    ):
        super().__init__()
        self._set(
            properties=list(properties), tools=list(tools), outputCol=outputCol,
            means=list(means), deviations=list(deviations),
        )

    @property
    def width(self) -> int:
        return len(self.getOrDefault("properties")) + len(self.getOrDefault("tools"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def value(c: str) -> Column:
            if c not in dataset.columns:
                return F.lit(None).cast("double")
            return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

        scaled = [
            F.coalesce((value(c) - m) / (s or 1.0), F.lit(0.0))
            for c, m, s in zip(
                self.getOrDefault("properties"), self.getOrDefault("means"), self.getOrDefault("deviations")
            )
        ]
        plain = [F.coalesce(value(c), F.lit(0.0)) for c in self.getOrDefault("tools")]
        cells = [*scaled, *plain]
        out = F.array(*cells) if cells else F.array().cast("array<double>")
        return dataset.withColumn(self.getOrDefault("outputCol"), out)
