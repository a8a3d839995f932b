"""Mean imputation and standardisation of feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(c: str) -> Column:
    """NaN counts as missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def fit_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean of the present values and deviation after imputation, per column.

    Imputing the mean adds no squared deviation, so one pass gives both numbers.
    """
    n = F.count(F.lit(1))
    stats = []
    for c in cols:
        x = _present(c)
        mean = F.coalesce(F.avg(x), F.lit(0.0))
        std = F.coalesce(F.sqrt(F.var_pop(x) * F.count(x) / n), F.lit(0.0))
        stats += [mean.alias(f"{c}_mean"), std.alias(f"{c}_std")]
    return df.agg(*stats)


def _stat_row(stats: DataFrame) -> Column:
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()


def impute_mean(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Missing values become the column mean; a column without values becomes 0."""
    row = _stat_row(fit_stats(df, cols) if stats is None else stats)
    return df.withColumns({c: F.coalesce(_present(c), row[f"{c}_mean"]) for c in cols})


def standardize(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Impute, then (x - mean) / population deviation; deviation 0 counts 1.

    Without ``stats`` the batch itself is measured; with them, fitted training values are used.
    """
    row = _stat_row(fit_stats(df, cols) if stats is None else stats)

    def scaled(c: str) -> Column:
        mean, std = row[f"{c}_mean"], row[f"{c}_std"]
        x = F.coalesce(_present(c), mean)
        return (x - mean) / F.when(std > 0, std).otherwise(F.lit(1.0))

    return df.withColumns({c: scaled(c) for c in cols})
