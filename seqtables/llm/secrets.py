"""Operator 10: secret scans over an incremental ledger of content-addressed blobs.

Every version of a file is addressed by the SHA-256 of its text. The ledger, a Parquet table,
holds one row for each blob and rule version that was scanned. A run scans only the pairs the
ledger lacks, each distinct blob once however many paths and versions hold it, appends them, and
joins the findings back to every path.

Defined results: a null text is the empty text; an empty text has no finding; equal rows get equal
findings, one output row for each input row; ledger rows that repeat a pair count once; an empty
table gives an empty result; columns of the input that are not named are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.llm.tables import short_lists, stored
from seqtables.session import scratch_path

# Kind, pattern, whether letters match in either case, group to measure, its least
# length. The order is the order of kinds at the same start. The last two are this method's own.
RULES = (
    (
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        True,
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    ("hex", r"[0-9a-f]+", False, 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", False, 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 40),
)
BASE_KINDS = ("assign", "access", "hex")
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rules string, findings {FINDINGS}"


def rules_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def compiled(rules) -> list[tuple]:
    """Patterns ready to run. A run of hex digits is asked for at its least length at once, which
    skips the many short runs without another result."""
    out = []
    for kind, pattern, either, group, least in rules:
        if group == 0 and pattern == "[0-9a-f]+":
            pattern = f"[0-9a-f]{{{least},}}"
        flags = re.ASCII | (re.IGNORECASE if either else 0)
        out.append((kind, re.compile(pattern, flags), group, least))
    return out


def find_secrets(text: str, rules: list[tuple]) -> list[tuple[int, int, int]]:
    """``(start, rule number, end)`` of all findings, sorted."""
    found = [
        (m.start(), number, m.end())
        for number, (_, pattern, group, least) in enumerate(rules)
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]
    return sorted(found)


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of ``(blob, text)``: a row-local pass."""
    version = rules_version(rules)
    kinds = [r[0] for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = compiled(rules)
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            found = []
            for text in batch.column(1):
                hits = find_secrets(text.as_py() or "", ready)
                found.append([{"kind": kinds[k], "start": s, "end": e} for s, k, e in hits])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.binary()),
                    pa.array([version] * len(found), pa.string()),
                    pa.array(found, pa.list_(span)),
                ],
                ["blob", "rules", "findings"],
            )

    return blobs.select("blob", "text").mapInArrow(scan, LEDGER)


def known_blobs(spark: SparkSession, folder: str, rules=RULES) -> DataFrame:
    """The ledger's rows of these rules."""
    rows = spark.read.schema(LEDGER).parquet(folder)
    return rows.filter(F.col("rules") == rules_version(rules))


def scan_history(
    versions: DataFrame, path: str, text: str, ledger: str | None = None, rules=RULES
) -> DataFrame:
    """``(path, blob, findings)`` for every version; new ledger rows are appended to ``ledger``.

    Without a ledger folder a new one is made in the shared folder. Only addresses are grouped;
    each unseen blob's text moves once, from the one row that was chosen to carry it.
    """
    spark = versions.sparkSession
    folder = ledger or scratch_path(spark, "blob-ledger")
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(folder)
    named = versions.select(F.col(path).alias("path"), F.col(text).alias("text"))
    addressed = named.select(
        "path", "text", address(F.col("text")).alias("blob"), F.xxhash64("path").alias("carrier")
    )
    paths = stored(addressed.select("path", "blob", "carrier"), "blob-paths")
    seen = known_blobs(spark, folder, rules).select("blob")
    unseen = (
        paths.groupBy("blob").agg(F.min("carrier").alias("carrier")).join(seen, "blob", "left_anti")
    )
    carried = addressed.select("blob", "carrier", "text").join(
        unseen, ["blob", "carrier"], "left_semi"
    )
    # The same path may hold the same text twice, so the narrow ledger rows are made distinct.
    scan_blobs(carried, rules).dropDuplicates(["blob"]).write.mode("append").parquet(folder)
    # Two writers, or a retried append, may leave a pair twice; its findings are the same.
    known = known_blobs(spark, folder, rules)
    hits = known.filter(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    return paths.join(hits, "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")
    )


def spans_text(findings: Column) -> Column:
    """``kind:start:end`` joined by commas, in the order of the findings."""
    return F.array_join(
        F.transform(
            findings,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def redacted(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """The text with every finding, overlapping ones as one, replaced by ``mark``."""

    def step(state: Column, span: Column) -> Column:
        apart = span["start"] >= state["at"]
        upto = F.substr(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], upto, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # The rest of the text begins after the last finding; its length bounds it from above.
    return F.when(
        F.size(findings) > 0,
        F.aggregate(
            findings,
            start,
            step,
            lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))),
        ),
    ).otherwise(text)


def redact_texts(docs: DataFrame, found: DataFrame, text: str, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the findings of ``scan_history`` redacted; all columns and rows are kept.

    Findings of few blobs go to the texts; only beyond the checked limit are the texts shuffled.
    """
    hits = (
        found.filter(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    )
    hits = short_lists(stored(hits, "blob-hits"), "findings")
    packed = docs.select(F.struct("*").alias("doc"), address(F.col(text)).alias("blob"))
    joined = packed.join(hits, "blob", "left")
    clean = redacted(F.col("doc")[text], F.col("findings"), mark)
    # Without findings the size is null or -1, and the text stays.
    return joined.select(
        *[(clean if c == text else F.col("doc")[c]).alias(c) for c in docs.columns]
    )


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts and spans for each path."""
    spans = F.col("findings")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("path").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )
