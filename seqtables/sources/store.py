"""Embedding table keyed by encoder settings and sequence content."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.operators.clean import dedup_keep_first
from seqtables.operators.joins import keyed_lookup
from seqtables.session import stored_table


def embedding_key(sequence: Column, backbone: str, pooling: str, max_length: int) -> Column:
    """Whole SHA-256: rows are joined by it, so a shortened one would mix up texts."""
    text = F.concat_ws("|", F.lit(backbone), F.lit(pooling), F.lit(str(max_length)), sequence)
    return F.sha2(text, 256)


# Leading hex digits of a key that name its range: a folder of the store.
RANGE_DIGITS = 2


def stored(spark: SparkSession, path: str, ranges: list[str] | None = None) -> DataFrame | None:
    """``(emb_key, embedding)`` of the store, or of the given key ranges only; None before the first call.

    Two writers may both have stored a key, so a key is read once.
    """
    try:
        table = spark.read.schema("emb_key string, embedding array<float>, key_range string").parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in (err.getCondition() or ""):
            return None
        raise
    if ranges is not None:
        table = table.filter(F.col("key_range").isin(ranges))
    return table.select("emb_key", "embedding").dropDuplicates(["emb_key"])


def embedding_store(
    df: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    path: str,
    backbone: str,
    pooling: str = "mean",
    max_length: int = 1024,
    sequence: str = "sequence",
) -> tuple[DataFrame, int]:
    """Rows with ``embedding`` attached and the number of sequences encoded in this call.

    Only sequences whose key is not stored yet are encoded, once each, and appended. ``encode``
    takes ``(emb_key, sequence)`` rows, the sequences cut to ``max_length``, and returns
    ``(emb_key, embedding)``. The store is a folder for each range of keys; a call reads the ranges its
    keys fall into (at most 256 names reach the driver), of the known ones the key column only. The rows
    are read once and kept with their keys in the shared folder.
    """
    spark = df.sparkSession
    keyed = df.withColumn("emb_key", embedding_key(F.col(sequence), backbone, pooling, max_length))
    keyed = stored_table(keyed, "keyed-rows")
    wanted = keyed.select(
        "emb_key", F.substring(F.col(sequence), 1, max_length).alias("sequence")
    )
    key_range = F.left("emb_key", F.lit(RANGE_DIGITS))
    touched = [r["r"] for r in wanted.select(key_range.alias("r")).distinct().collect() if r["r"]]
    have = stored(spark, path, touched)
    # Known keys go before the others are shuffled.
    unknown = wanted if have is None else wanted.join(have.select("emb_key"), "emb_key", "left_anti")
    new = dedup_keep_first(unknown, "emb_key", ["emb_key"])
    # Rows of this call are told by its mark, which a count reads alone.
    call = uuid.uuid4().hex
    encoded = encode(new).select("emb_key", F.col("embedding").cast("array<float>"), F.lit(call).alias("call"))
    encoded.withColumn("key_range", key_range).repartition("key_range").write.mode("append").partitionBy(
        "key_range"
    ).parquet(path)
    marks = spark.read.schema("call string, key_range string").parquet(path)
    added = marks.filter(F.col("key_range").isin(touched) & (F.col("call") == call)).count()
    table = stored(spark, path, touched)
    return keyed_lookup(keyed, table, "emb_key", broadcast_rows=5_000), added
