"""External label sets joined to their sequences by record alias."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.functions.annotations import (
    external_tokens,
    map_external_labels,
    record_id_aliases,
)
from seqtables.operators.clean import dedup_keep_first
from seqtables.operators.joins import keyed_lookup


def alias_table(sequences: DataFrame, key: str, sequence: str, order: str) -> DataFrame:
    """``(alias, accession, sequence)``; the first record owning an alias keeps it.

    Lookups resolve aliases on the two narrow columns; a sequence moves only to the row it joins.
    """
    aliases = sequences.select(
        F.explode(record_id_aliases(F.col(key))).alias("alias"),
        F.col(key).alias("accession"),
        F.col(sequence).alias("sequence"),
        F.col(order).alias("_ord"),
    )
    return dedup_keep_first(aliases, "alias", ["_ord"]).drop("_ord")


def _looked_up(
    labels: DataFrame, aliases: DataFrame, label_map: Mapping[str, str] | None
) -> DataFrame:
    text = F.coalesce(F.col("raw_locations"), F.lit(""))
    keyed = labels.withColumn("alias", F.col("id"))
    narrow = aliases.select("alias", "accession")
    return keyed_lookup(keyed, narrow, "alias", "left").select(
        "id",
        "alias",
        "accession",
        text.alias("raw_locations"),
        map_external_labels(text, label_map).alias("locations"),
    )


def join_reference(
    labels: DataFrame, aliases: DataFrame, label_map: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows with a sequence and at least one mapped label."""
    found = _looked_up(labels, aliases, label_map).filter(
        F.col("accession").isNotNull() & (F.size("locations") > 0)
    )
    return found.join(aliases.select("alias", "sequence"), "alias").select(
        "accession",
        "sequence",
        "locations",
        F.array_join("locations", "|").alias("locations_str"),
        "raw_locations",
    )


def reference_skips(
    labels: DataFrame, aliases: DataFrame, label_map: Mapping[str, str] | None = None
) -> DataFrame:
    """One row: source rows, rows without a sequence, rows without a mapped label."""
    found = _looked_up(labels, aliases, label_map)
    missing = F.col("accession").isNull()
    return found.agg(
        F.count(F.lit(1)).alias("n_source_rows"),
        F.count_if(missing).alias("n_skipped_missing_sequence"),
        F.count_if(~missing & (F.size("locations") == 0)).alias("n_skipped_unmapped_labels"),
    )


def unmapped_labels(
    labels: DataFrame, aliases: DataFrame, label_map: Mapping[str, str] | None = None
) -> DataFrame:
    """``(name)``: distinct names in rows that have a sequence but no mapped label."""
    found = _looked_up(labels, aliases, label_map)
    return (
        found.filter(F.col("accession").isNotNull() & (F.size("locations") == 0))
        .select(F.explode(external_tokens(F.col("raw_locations"))).alias("name"))
        .distinct()
    )
