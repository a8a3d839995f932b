"""Request stream -> accepted, scored rows and refused rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqtables import params as P
from seqtables.functions.sequences import normalize_request, request_error
from seqtables.plans.models import Scorer, load_scorer, newest_bundle, score_batch


def read_requests(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """File stream of request tables."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def mark_requests(requests: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Stateless: ``error`` and the normalized sequence; no watermark is needed."""
    return requests.withColumn("error", request_error(F.col(sequence))).withColumn(
        sequence,
        F.when(F.col("error").isNull(), normalize_request(F.col(sequence))).otherwise(
            F.col(sequence)
        ),
    )


def respond(
    accepted: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = P.THRESHOLD
) -> DataFrame:
    """Scored rows with the response columns."""
    return score(accepted.withColumn("sequence_length", F.length("sequence"))).withColumn(
        "threshold", F.lit(float(threshold))
    )


def score_stream(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
    threshold: float = P.THRESHOLD,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the query; each micro-batch goes to two Parquet sinks.

    Output of a batch lives in its own ``batch`` directory and is overwritten when the batch is
    replayed after a failure, so rows are neither lost nor doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            ok = respond(rows.filter(F.col("error").isNull()).drop("error"), score, threshold)
            ok.write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
            rows.filter(F.col("error").isNotNull()).write.mode("overwrite").parquet(
                f"{rejected_path}/batch={batch_id}"
            )
        finally:
            rows.unpersist()

    writer = (
        mark_requests(requests)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def pinned_bundle(spark: SparkSession, bundles: str, pin: str) -> str:
    """The bundle a micro-batch is scored with: the newest one when the batch first ran."""
    try:
        return spark.read.parquet(pin).first()["bundle"]
    except AnalysisException:
        chosen = newest_bundle(spark, bundles)
        spark.range(1).select(F.lit(chosen).alias("bundle")).coalesce(1).write.parquet(pin)
        return chosen


def serve_stream(
    requests: DataFrame,
    bundles: str,
    encode: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    threshold: float = P.THRESHOLD,
    top_k: int = P.TOP_K,
    available_now: bool = True,
) -> StreamingQuery:
    """Score requests with the stored bundles below ``bundles``; ``encode`` adds ``features``.

    Every micro-batch takes the newest bundle and keeps it: a bundle saved in between serves the next
    batch, and a batch replayed after a failure is scored as before. Accepted and refused rows are
    written to folders of the batch, then one row commits both; ``served`` reads committed batches
    only, so rows are neither lost, doubled nor seen by half.
    """
    root = out.rstrip("/")
    held: dict[str, Scorer] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bundle = pinned_bundle(spark, bundles, f"{root}/pins/batch={batch_id}")
        if bundle not in held:
            held.clear()
            held[bundle] = load_scorer(spark, bundles, path=bundle)
        rows = batch.persist()
        try:
            refused = F.col("error").isNotNull()
            scored = respond(
                rows.filter(~refused).drop("error"),
                lambda df: score_batch(encode(df), held[bundle], top_k=top_k, threshold=threshold),
                threshold,
            )
            kept = [c for c in rows.columns if c != "error"]
            told = scored.select(*kept, "sequence_length", "predictions", "threshold", F.lit(bundle).alias("bundle"))
            told.write.mode("overwrite").parquet(f"{root}/accepted/batch={batch_id}")
            rows.filter(refused).write.mode("overwrite").parquet(f"{root}/rejected/batch={batch_id}")
            sizes = rows.agg(F.count_if(~refused).alias("accepted"), F.count_if(refused).alias("rejected"))
            sizes.select(F.lit(bundle).alias("bundle"), "accepted", "rejected").coalesce(1).write.mode(
                "overwrite"
            ).parquet(f"{root}/commits/batch={batch_id}")
        finally:
            rows.unpersist()

    writer = (
        mark_requests(requests)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def served(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, commits) of the committed batches; one commit row a micro-batch."""
    root = out.rstrip("/")
    commits = spark.read.option("basePath", f"{root}/commits").parquet(f"{root}/commits")
    whole = F.broadcast(commits.select("batch"))
    sides = [
        spark.read.option("basePath", f"{root}/{side}").parquet(f"{root}/{side}").join(whole, "batch", "left_semi")
        for side in ("accepted", "rejected")
    ]
    return sides[0], sides[1], commits
