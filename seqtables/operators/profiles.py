"""Data-quality reports as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.sequences import has_nonstandard
from seqtables.operators.labels import label_counts

CHECK_COLUMNS = ("check", "severity", "value", "message")


def profile_raw(
    df: DataFrame,
    key: str = "accession",
    sequence: str = "sequence",
    required: Sequence[str] = P.REQUIRED_RAW,
) -> DataFrame:
    """One row of raw statistics. Row-level numbers take one pass without a keyed shuffle."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    rows = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
        F.count_if(has_nonstandard(F.col(sequence))).alias("nonstandard_sequences"),
        F.avg(F.length(sequence)).alias("sequence_length_mean"),
        F.median(F.length(sequence)).alias("sequence_length_median"),
    )
    distinct = df.agg(F.count_distinct(key).alias("u")).scalar()
    has_null = F.when(F.col(f"null_{key}") > 0, 1).otherwise(0) if key in required else F.lit(0)
    return rows.withColumn("unique_accessions", distinct).withColumn(
        "duplicate_accessions", F.col("total_rows") - F.col("unique_accessions") - has_null
    )


def profile_processed(
    df: DataFrame, min_samples: int = P.MIN_SAMPLES, col: str = "locations"
) -> DataFrame:
    """One row of label statistics after mapping."""
    rows = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.size(col) == 0).alias("unlabelled_rows"),
        F.round(F.avg(F.size(col)), 2).alias("avg_labels_per_row"),
        F.round(F.avg((F.size(col) > 1).cast("int")), 3).alias("multi_label_fraction"),
    )
    classes = label_counts(df, col).agg(
        F.struct(
            F.count(F.lit(1)).alias("num_classes"),
            F.count_if(F.col("n") < min_samples).alias("classes_below_min"),
            F.when(
                F.count(F.lit(1)) >= 2, F.round(F.max("n") / F.min("n"), 1)
            ).alias("max_min_class_ratio"),
        ).alias("c")
    )
    return rows.withColumn("_c", classes.scalar()).select(*rows.columns, "_c.*")


def processed_checks(profile: DataFrame) -> DataFrame:
    """``(check, severity, value, message)`` rows of a processed profile."""
    return _checks(
        profile,
        [
            ("unlabelled_rows", "error", F.col("unlabelled_rows"), "rows have no label"),
            ("classes_below_min", "warning", F.col("classes_below_min"), "classes below the minimum"),
            (
                "class_imbalance",
                "warning",
                F.when(F.col("max_min_class_ratio") > 50, F.col("max_min_class_ratio")),
                "largest/smallest class ratio above 50",
            ),
        ],
    )


def raw_checks(profile: DataFrame, required: Sequence[str] = P.REQUIRED_RAW) -> DataFrame:
    """``(check, severity, value, message)`` rows of a raw profile."""
    return _checks(
        profile,
        [(f"null_{c}", "warning", F.col(f"null_{c}"), f"null values in {c}") for c in required]
        + [
            ("duplicates", "warning", F.col("duplicate_accessions"), "duplicate accessions"),
            (
                "nonstandard",
                "warning",
                F.col("nonstandard_sequences"),
                "sequences with non-standard residues",
            ),
        ],
    )


def _checks(profile: DataFrame, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.lit(severity).alias("severity"),
                value.cast("double").alias("value"),
                F.lit(message).alias("message"),
            )
            for name, severity, value, message in rules
        ]
    )
    return profile.select(F.inline(rows)).filter(F.col("value") > 0)


def checks_pass(checks: DataFrame) -> bool:
    """True when no row is an error."""
    return checks.filter(F.col("severity") == "error").isEmpty()


def profile_splits(df: DataFrame, col: str = "locations") -> DataFrame:
    """``(split, size, label, share)``: rows per split and its normalised label distribution."""
    counts = (
        df.select("split", F.explode(col).alias("label"))
        .groupBy("split", "label")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    total = F.sum("_n").over(Window.partitionBy("split"))
    sizes = df.groupBy("split").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(
        counts.select("split", "label", (F.col("_n") / total).alias("share")), "split", "left"
    ).select("split", "size", "label", "share")


def empty_splits(df: DataFrame, expected: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Expected splits without rows, as error checks."""
    sizes = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(n) for n in expected])
    have = sizes.filter(F.col("n") > 0).agg(
        F.array_except(names, F.collect_set("split")).alias("gone")
    )
    return have.select(
        F.lit("empty_split").alias("check"),
        F.lit("error").alias("severity"),
        F.lit(0.0).alias("value"),
        F.explode("gone").alias("message"),
    )


def split_leakage(df: DataFrame, key: str = "accession") -> DataFrame:
    """``(split_a, split_b, shared)``: keys present in both splits of a pair."""
    places = df.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = places.filter(F.size("s") > 1).select(
        F.explode(
            F.flatten(
                F.transform(
                    "s",
                    lambda a: F.transform(
                        F.filter("s", lambda b: b > a),
                        lambda b: F.struct(a.alias("split_a"), b.alias("split_b")),
                    ),
                )
            )
        ).alias("p")
    )
    return pairs.groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("shared"))
