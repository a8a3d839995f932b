"""Raw rows -> cleaned, labelled rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.annotations import (
    labels_to_string,
    map_to_groups,
    parse_annotations,
    single_label,
)
from seqtables.functions.sequences import is_valid_sequence, normalize_request, request_error
from seqtables.operators.joins import keyed_lookup
from seqtables.operators.ranking import grouped_row_number
from seqtables.session import materialize

# Up to this rank Spark limits every group on the map side, before the shuffle.
GROUP_LIMIT = 1000


def normalize_columns(
    df: DataFrame,
    column_map: Mapping[str, str] | None = None,
    required: Sequence[str] = P.REQUIRED_RAW,
) -> DataFrame:
    """Rename source columns; a missing required column is an error at plan time."""
    column_map = P.RAW_COLUMNS if column_map is None else column_map
    renames: dict[str, str] = {}
    for old, new in column_map.items():
        if old in df.columns and new not in renames.values():
            renames[old] = new
    out = df.withColumnsRenamed(renames)
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Available: {out.columns}")
    return out


def cap_per_source(
    df: DataFrame, key: str, order: Sequence[str], n: int, **limits
) -> DataFrame:
    """At most the first ``n`` rows of every source; ``order`` must be unique within a source.

    Rows without a source are one source of their own, whatever ``n`` is.
    """
    if n < 1:
        raise ValueError("n must be positive")
    if n <= GROUP_LIMIT:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")
    # Large caps: find the order value of the n-th row per full source on narrow columns, then
    # filter the wide rows in place.
    # The joins run on a text of the source that is never null.
    source = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    named = df.withColumn("_source", source)
    full = materialize(
        named.groupBy("_source")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > n)
        .select("_source")
    )
    narrow = keyed_lookup(named.select("_source", *order), full, "_source", **limits)
    ranked = grouped_row_number(narrow, ["_source"], list(order), "_rn")
    last = ranked.filter(F.col("_rn") == n - 1).select("_source", F.struct(*order).alias("_last"))
    marked = keyed_lookup(named, materialize(last), "_source", "left", **limits)
    keep = F.col("_last").isNull() | (F.struct(*order) <= F.col("_last"))
    return marked.filter(keep).select(*df.columns)


def dedup_keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``; the limit of one runs before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null or empty value in any of the columns."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df


def with_locations(
    df: DataFrame,
    text: str = "subcellular_location",
    groups: Mapping[str, Sequence[str]] | None = None,
    multi_label: bool = True,
) -> DataFrame:
    """Parse the annotation text, map it to groups, keep the rows with at least one."""
    labels = map_to_groups(parse_annotations(F.col(text)), groups)
    out = filter_labelled(df.withColumn("locations", labels))
    return out if multi_label else out.withColumn("locations", single_label(F.col("locations")))


def filter_labelled(df: DataFrame, col: str = "locations") -> DataFrame:
    return df.filter(F.size(col) > 0)


def filter_sequences(df: DataFrame, col: str = "sequence", **bounds) -> DataFrame:
    return df.filter(is_valid_sequence(F.col(col), **bounds))


def project_processed(df: DataFrame) -> DataFrame:
    """Fixed output columns; organism columns only when present."""
    optional = [c for c in ("organism_id", "organism_name") if c in df.columns]
    return df.select(
        "accession",
        "sequence",
        "locations",
        labels_to_string(F.col("locations")).alias("locations_str"),
        *optional,
    )


def validate_requests(
    df: DataFrame, col: str = "sequence", batch: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (normalized) and refused rows (with ``error``)."""
    marked = df.withColumn("error", request_error(F.col(col), batch_max=P.MAX_LENGTH if batch else None))
    accepted = marked.filter(F.col("error").isNull()).drop("error")
    return (
        accepted.withColumn(col, normalize_request(F.col(col))),
        marked.filter(F.col("error").isNotNull()),
    )


def sequence_from_text(text: Column) -> Column:
    """Residue letters of any text: letters only, upper case, four rare codes mapped."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]+", ""))
    # No code is mapped to another mapped one; a replacement scans bytes, translate makes a string a letter.
    for rare, common in zip("BJOZ", "NLKQ"):
        letters = F.replace(letters, F.lit(rare), F.lit(common))
    return letters
