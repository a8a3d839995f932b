"""Reading, storing and folding shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seqtables.session import scratch_path

FOLDS = 5
# List entries that a broadcast table may hold in all its rows together.
BROADCAST_ENTRIES = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends, columns can be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def integer_ids(df: DataFrame, row_id: str) -> Column:
    """The ids as 64-bit numbers. Ids of another type are refused before any work begins."""
    kind = df.schema[row_id].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"ids in {row_id!r} must be integers, not {kind.simpleString()}")
    return F.col(row_id).cast("long")


def short_lists(rows: DataFrame, lists: str, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """Marks a stored table for broadcasting if its rows and the entries of its lists are few."""
    total = rows.agg(F.sum(F.size(lists) + 1).alias("n")).first()["n"] or 0
    return F.broadcast(rows) if total <= most else rows


def held_out(doc_id: Column) -> Column:
    """One fold of five by crc32 of the id as text; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
