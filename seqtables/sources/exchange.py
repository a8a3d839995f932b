"""Exchange formats of external tools: FASTA, label files, predictor output."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.functions.annotations import map_external_labels, strip
from seqtables.operators.reference import (
    alias_table,
    join_reference,
    reference_skips,
    unmapped_labels,
)
from seqtables.session import stored_table


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(id, description, sequence, ord)``; ``ord`` grows with the position in the files.

    Records are split on a newline followed by ``>``, so large files are read in parallel. Text
    before the first ``>`` of a file belongs to no record.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    pieces = records.select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ord"),
    )
    # The separator takes the mark of every piece but a file's first; a first one without is no record.
    first = F.min_by(F.struct("ord", F.col("value").startswith(">").alias("marked")), "ord.row")
    loose = pieces.filter("ord.start = 0").groupBy("ord.file").agg(first.alias("f"))
    loose = loose.filter("NOT f.marked").select("f.ord")
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    header = F.substring_index(F.col("_text"), "\n", 1)
    body = F.substring(F.col("_text"), F.length(header) + 2, F.length("_text"))
    return (
        pieces.join(loose, "ord", "left_anti")
        .select(text.alias("_text"), "ord")
        .filter(F.length(strip(F.col("_text"))) > 0)
        .select(
            F.split(strip(header), r"\s+")[0].alias("id"),
            strip(header).alias("description"),
            strip(F.regexp_replace(body, r"[ \t]*\n\s*", "")).alias("sequence"),
            "ord",
        )
    )


def write_fasta(df: DataFrame, path: str, key: str = "accession", sequence: str = "sequence") -> None:
    df.select(
        F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(sequence)).alias("value")
    ).write.mode("overwrite").text(path)


def read_label_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``(id, raw_locations)``; fewer than two columns is an error."""
    width = len(spark.read.option("sep", "\t").csv(path).columns)
    if width < 2:
        raise ValueError("label file needs at least two tab-separated columns")
    rows = spark.read.option("sep", "\t").csv(path)
    return rows.select(
        F.col("_c0").alias("id"), F.coalesce("_c1", F.lit("")).alias("raw_locations")
    )


def read_prediction_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(id, raw_locations)`` from a prediction table; null labels become empty text."""
    rows = spark.read.option("header", True).csv(path)
    missing = {"Protein_ID", "Localizations"} - set(rows.columns)
    if missing:
        raise ValueError(f"Missing required columns: {sorted(missing)}. Available: {rows.columns}")
    return rows.select(
        F.col("Protein_ID").alias("id"),
        F.coalesce("Localizations", F.lit("")).alias("raw_locations"),
    )


def _try_read(read, spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read(spark, path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in (err.getCondition() or ""):
            return None
        raise


def load_reference_set(
    spark: SparkSession,
    folder: str,
    label_map: Mapping[str, str] | None = None,
    fasta: str = "test.fasta",
    labels: str = "test_labels.tsv",
    predictions: str = "outputs/results_test.csv",
) -> tuple[DataFrame, dict]:
    """Reference rows plus how they were obtained (``unmapped_labels`` is a frame of names).

    The label file wins when at least one of its rows maps to a known class; otherwise the
    prediction table is used; neither is an error.
    """
    root = folder.rstrip("/")
    sequences = _try_read(read_fasta, spark, f"{root}/{fasta}")
    if sequences is None:
        raise FileNotFoundError(f"no sequence file at {root}/{fasta}")
    chosen, kind, source = None, None, None
    truth = _try_read(read_label_tsv, spark, f"{root}/{labels}")
    guess = _try_read(read_prediction_csv, spark, f"{root}/{predictions}")
    if truth is not None:
        known = truth.filter(F.size(map_external_labels(F.col("raw_locations"), label_map)) > 0)
        if not known.isEmpty():
            chosen, kind, source = truth, "ground_truth_labels", f"{root}/{labels}"
        elif guess is None:
            raise RuntimeError("the label file holds no recognizable labels")
    if chosen is None and guess is not None:
        chosen, kind, source = guess, "tool_predictions", f"{root}/{predictions}"
    if chosen is None:
        raise FileNotFoundError(f"no reference labels below {root}")
    aliases = stored_table(alias_table(sequences, "id", "sequence", "ord"), "aliases")
    rows = join_reference(chosen, aliases, label_map)
    if rows.isEmpty():
        raise RuntimeError("the reference set has no row with a known label")
    stats = reference_skips(chosen, aliases, label_map).first().asDict()
    names = unmapped_labels(chosen, aliases, label_map)
    return rows, {
        "reference_type": kind,
        "reference_source": source,
        **stats,
        "unmapped_labels": names,
    }


def read_cluster_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(representative, member, ordinal)`` of an aligner's cluster table."""
    rows = spark.read.option("sep", "\t").schema("representative string, member string").csv(path)
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def last_per_id(rows: DataFrame) -> DataFrame:
    """One row per ``id``, that of the last line (``_line`` grows with the position)."""
    cols = [c for c in rows.columns if c not in ("id", "_line")]
    last = rows.groupBy("id").agg(F.max(F.struct("_line", *cols)).alias("_last"))
    return last.select("id", *[F.col("_last")[c].alias(c) for c in cols])


def read_signal_peptide_results(spark: SparkSession, path: str) -> DataFrame:
    """``(id, has_sp, sp_prob)``; comments, blank and short lines are skipped.

    An id that is reported again keeps its last line.
    """
    fields = F.split("value", "\t")
    return last_per_id(
        spark.read.text(path)
        .withColumn("_line", F.monotonically_increasing_id())
        .filter(~F.col("value").startswith("#") & (F.length(strip(F.col("value"))) > 0))
        .select("_line", fields.alias("f"))
        .filter(F.size("f") >= 3)
        .select(
            F.col("f")[0].alias("id"),
            (F.col("f")[1] != "OTHER").cast("double").alias("has_sp"),
            F.coalesce(F.col("f")[2].try_cast("double"), F.lit(0.0)).alias("sp_prob"),
            "_line",
        )
    )


def read_tm_results(spark: SparkSession, path: str) -> DataFrame:
    """``(id, n_helices, has_tm, tm_fraction)`` from ``key=value`` result lines, the last per id."""
    value = F.col("value")

    def number(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(value, pattern, 1).try_cast("double"), F.lit(0.0))

    helices = number(r"PredHel=(\d+)")
    return last_per_id(
        spark.read.text(path)
        .select(
            F.monotonically_increasing_id().alias("_line"),
            F.regexp_extract(value, r"(seq_\d+)", 1).alias("id"),
            helices.alias("n_helices"),
            (helices > 0).cast("double").alias("has_tm"),
            (number(r"ExpAA=([\d.]+)") / F.greatest(number(r"len=(\d+)"), F.lit(1.0))).alias(
                "tm_fraction"
            ),
        )
        .filter(F.length("id") > 0)
    )


def with_tool_features(df: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Left join tool results; rows the tool did not report get zeros."""
    cols = [c for c in results.columns if c != key]
    return df.join(results, key, "left").na.fill(0.0, cols)
