"""Feature blocks in a fixed order with a width known from the configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqtables import params as P

# Order of the blocks; the biophysical block takes its columns from the configuration.
BLOCKS: dict[str, tuple[str, ...] | None] = {
    "biophysical": None,
    "signal_peptide": ("has_sp", "sp_prob"),
    "transmembrane": ("n_helices", "has_tm", "tm_fraction"),
}


def feature_columns(
    enabled: Mapping[str, bool], properties: Sequence[str] = P.DEFAULT_PROPERTIES
) -> list[str]:
    names: list[str] = []
    for block, columns in BLOCKS.items():
        if enabled.get(block, False):
            names.extend(properties if columns is None else columns)
    return names


def feature_dim(
    enabled: Mapping[str, bool], properties: Sequence[str] = P.DEFAULT_PROPERTIES
) -> int:
    return len(feature_columns(enabled, properties))


def concat_features(
    enabled: Mapping[str, bool], properties: Sequence[str] = P.DEFAULT_PROPERTIES
) -> Column:
    """One array of the enabled blocks; a value a tool did not give counts 0."""
    names = feature_columns(enabled, properties)
    if not names:
        return F.array().cast("array<double>")
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
