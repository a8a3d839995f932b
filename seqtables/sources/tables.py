"""Raw, processed and split tables on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtables.functions.annotations import labels_to_string, string_to_labels

RAW_SCHEMA = T.StructType(
    [
        T.StructField("accession", T.StringType(), False),
        T.StructField("sequence", T.StringType()),
        T.StructField("subcellular_location", T.StringType()),
        T.StructField("organism_id", T.IntegerType()),
        T.StructField("organism_name", T.StringType()),
    ]
)

# Result pages come with the source's own column names.
PAGE_COLUMNS = ("Entry", "Sequence", "Subcellular location [CC]", "Organism (ID)", "Organism")


def spread_scan(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer tasks than the session has cores.

    A small file may be one row group and would keep one core busy. Tables with enough splits,
    which is every large one, are returned unchanged and never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_raw(spark: SparkSession, paths: str | list[str], sep: str = "\t") -> DataFrame:
    """Tab-separated result pages with a header.

    The paths of a list are matched by column name. Within one path (a folder or pattern) all
    pages must have the same header; another one is an error, not a mix of columns.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("multiLine", False)
    reader = reader.option("enforceSchema", False)
    pages = [reader.csv(p) for p in ([paths] if isinstance(paths, str) else paths)]
    return reduce(lambda a, b: a.unionByName(b), pages)


def write_raw(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Raw snapshot; nested columns are not allowed in CSV."""
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet keeps the label array; CSV carries the joined string instead."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    flat = df.withColumn("locations_str", labels_to_string(F.col("locations"))).drop("locations")
    write_raw(flat, path, "csv")


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return restore_locations(df)


def restore_locations(df: DataFrame) -> DataFrame:
    """Label array from ``locations_str`` when the array column is missing."""
    if "locations" in df.columns:
        return df
    if "locations_str" not in df.columns:
        raise ValueError("Missing 'locations' or 'locations_str' column")
    return df.withColumn("locations", string_to_labels(F.col("locations_str")))


def write_splits(df: DataFrame, path: str) -> None:
    """One directory per split, so loading a split prunes the others."""
    out = df.drop("locations_str") if "locations_str" in df.columns else df
    if "locations" in out.columns:
        out = out.withColumn("locations_str", labels_to_string(F.col("locations"))).drop(
            "locations"
        )
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return restore_locations(df) if "locations_str" in df.columns else df
