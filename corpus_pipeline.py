"""A corpus pipeline over ``documents``: quality, near duplicates, benchmark, secrets, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last keep
the columns of ``documents``; where a text changes, ``n_chars`` follows.

Defined results: a null text is judged as the empty text and stays null; texts without words are no
near copies of each other; rows that repeat an id and its text become one, rows with a null id are
never dropped as copies; an empty table passes through; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.llm.catalog import tokenizer_path
from seqtables.llm.decontam import clean_documents
from seqtables.llm.jaccard import jaccard_components, small_or_shuffled
from seqtables.llm.packing import pack_documents
from seqtables.llm.quality import keep_good
from seqtables.llm.secrets import redact_texts, scan_history
from seqtables.llm.tables import held_out, stored, table

WIDTH, PERCENT = 5, 80


def measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    changed = F.length("text").cast(kind)
    return docs.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score reaches the threshold."""
    labels = table(spark, sf_dir, "labels")
    return keep_good(docs, labels, "doc_id", "text", "quality", ~held_out(F.col("row_id")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    found = jaccard_components(docs, "doc_id", "text", WIDTH, PERCENT)
    copies = found.filter(F.col("row_id") != F.col("component_id")).select("row_id").distinct()
    copies = small_or_shuffled(stored(copies, "near-copies"))
    kept = docs.join(copies, docs["doc_id"] == copies["row_id"], "left_anti")
    # Rows that repeat an id and its text are one document. Most tables have none.
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = stored(ids.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("row_id")), "repeated")
    if repeated.isEmpty():
        return kept
    same = kept["doc_id"] == repeated["row_id"]
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that mostly consist of them go."""
    return measured(clean_documents(docs, table(spark, sf_dir, "benchmark")))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    found = scan_history(docs, "doc_id", "text")
    return measured(redact_texts(docs, found, "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece with its training sequence and its place there."""
    return pack_documents(docs, "doc_id", "text", tokenizer_path()).withColumnRenamed(
        "row_id", "doc_id"
    )


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", decontaminate),
    ("secrets", hide_secrets),
    ("pack", pack),
]

# Fitted scores and a packing search are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
