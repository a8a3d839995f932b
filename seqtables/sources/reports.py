"""Metric reports and per-class parameter files."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtables import params as P

METRIC_SCHEMA = (
    "overall map<string,double>, train map<string,double>, val map<string,double>, "
    "test map<string,double>, per_class map<string,map<string,double>>, "
    "test_per_class map<string,map<string,double>>, n_samples bigint, n_source_rows bigint, "
    "n_skipped_unmapped_labels bigint, reference_type string"
)


def read_metrics_json(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(model, path, status, report)`` per path; missing or broken files give a null report."""

    def one(model: str, path: str) -> DataFrame:
        named = [F.lit(model).alias("model"), F.lit(path).alias("path")]
        try:
            text = spark.read.text(path, wholetext=True)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in (err.getCondition() or ""):
                raise
            return spark.range(1).select(
                *named,
                F.lit("missing").alias("status"),
                F.from_json(F.lit(None).cast("string"), METRIC_SCHEMA).alias("report"),
            )
        whole = F.trim("value")
        valid = whole.startswith("{") & F.try_parse_json(whole).isNotNull()
        report = F.when(valid, F.from_json(whole, METRIC_SCHEMA))
        return text.select(
            *named,
            F.when(valid, "found").otherwise("invalid").alias("status"),
            report.alias("report"),
        )

    if not paths:
        raise ValueError("no report paths given")
    return reduce(lambda a, b: a.unionByName(b), [one(m, p) for m, p in paths.items()])


def report_lines(per_class: DataFrame, overall: DataFrame) -> DataFrame:
    """Fixed-width text report ``(line_no, line)``: classes, averages, closing lines."""
    row = "%-28s %10s %10s %10s %10s"
    num = "%-28s %10.3f %10.3f %10.3f %10d"
    rule = "-" * 70
    classes = per_class.select(
        (F.col("label_idx") + 2).cast("long").alias("line_no"),
        F.format_string(num, "label", "precision", "recall", "f1", F.col("support").cast("long")).alias(
            "line"
        ),
    )
    head = per_class.sparkSession.range(1).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).cast("long").alias("line_no"),
                    F.format_string(
                        row, *[F.lit(x) for x in ("Class", "Precision", "Recall", "F1", "Support")]
                    ).alias("line"),
                ),
                F.struct(F.lit(1).cast("long").alias("line_no"), F.lit(rule).alias("line")),
            )
        )
    )
    size = per_class.agg(F.count(F.lit(1)).alias("n")).scalar()
    tail = overall.select(
        F.posexplode(
            F.array(
                F.lit(rule),
                F.format_string(
                    num,
                    F.lit("Macro avg"),
                    "precision_macro",
                    "recall_macro",
                    "f1_macro",
                    F.col("total_samples").cast("long"),
                ),
                F.lit(""),
                F.format_string("Exact match ratio: %.3f", "exact_match_ratio"),
                F.format_string("Hamming loss: %.4f", "hamming_loss"),
            )
        ).alias("i", "line")
    ).select((F.col("i") + 2 + size).cast("long").alias("line_no"), "line")
    return head.unionByName(classes).unionByName(tail)


def write_metrics(per_class: DataFrame, overall: DataFrame, path: str) -> None:
    """JSON (sorted keys), per-class CSV and text report below ``path``; class-sized tables."""
    root = path.rstrip("/")
    ordered = overall.select(*sorted(overall.columns))
    ordered.coalesce(1).write.mode("overwrite").json(f"{root}/overall_json")
    per_class.orderBy("label_idx").coalesce(1).write.mode("overwrite").option(
        "header", True
    ).csv(f"{root}/per_class_csv")
    report_lines(per_class, overall).orderBy("line_no").select("line").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{root}/report_txt")


def save_class_params(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_class_params(spark: SparkSession, path: str, value: str) -> DataFrame | None:
    """``(label_idx, value)`` or None when the table is missing or has other columns."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    if "label_idx" not in table.columns or value not in table.columns:
        return None
    return table.select("label_idx", value)


def comparison_markdown(table: DataFrame) -> DataFrame:
    """Comparison rows as Markdown lines ``(line_no, line)``."""
    metrics = list(P.HEADLINE_METRICS)
    head = table.sparkSession.range(1).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("line_no"),
                    F.lit("| Model | " + " | ".join(metrics) + " |").alias("line"),
                ),
                F.struct(
                    F.lit(1).alias("line_no"),
                    F.lit("|---|" + "|".join(["---:"] * len(metrics)) + "|").alias("line"),
                ),
            )
        )
    )
    rows = table.select(
        (F.col("model_ord") + 2).alias("line_no"),
        F.concat(
            F.lit("| "), F.col("model"), F.lit(" | "), F.concat_ws(" | ", *metrics), F.lit(" |")
        ).alias("line"),
    )
    return head.unionByName(rows)


def class_markdown(reports: DataFrame, model: str, field: str) -> DataFrame:
    """Per-class Markdown lines of one model's report; no report -> no lines."""

    def shown(v):
        return F.when(v.isNull(), "—").otherwise(F.format_string("%.3f", v))

    found = reports.filter((F.col("model") == model) & F.col(f"report.{field}").isNotNull())
    rows = found.select(F.posexplode(F.map_entries(f"report.{field}")).alias("i", "e")).select(
        (F.col("i") + 2).alias("line_no"),
        F.concat(
            F.lit("| "),
            F.col("e.key"),
            *[
                F.concat(F.lit(" | "), shown(F.try_element_at(F.col("e.value"), F.lit(m))))
                for m in ("precision", "recall", "f1")
            ],
            F.lit(" | "),
            F.coalesce(
                F.try_element_at(F.col("e.value"), F.lit("support")).cast("bigint").cast("string"),
                F.lit("—"),
            ),
            F.lit(" |"),
        ).alias("line"),
    )
    head = found.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(0).alias("line_no"),
                    F.lit("| Class | Precision | Recall | F1 | Support |").alias("line"),
                ),
                F.struct(F.lit(1).alias("line_no"), F.lit("|---|---:|---:|---:|---:|").alias("line")),
            )
        )
    )
    return head.unionByName(rows)


def benchmark_wording(reports: DataFrame, model: str) -> DataFrame:
    """One sentence on the external benchmark, worded by how its labels were obtained."""
    r = F.col("report")
    text = (
        F.when(r.isNull(), "External benchmark not run yet.")
        .when(
            r["reference_type"] == "tool_predictions",
            F.concat(
                F.format_string(
                    "Evaluated on %d of %d demo sequences, with another tool's predictions as "
                    "the reference labels.",
                    r["n_samples"],
                    F.coalesce(r["n_source_rows"], r["n_samples"]),
                ),
                F.when(
                    r["n_skipped_unmapped_labels"] > 0,
                    F.format_string(
                        " %d sequences were dropped because their labels have no class here.",
                        r["n_skipped_unmapped_labels"],
                    ),
                ).otherwise(""),
            ),
        )
        .otherwise(F.format_string("Evaluated on %d labelled sequences.", r["n_samples"]))
    )
    return reports.filter(F.col("model") == model).select(text.alias("line"))


def files_consumed(reports: DataFrame) -> DataFrame:
    """Provenance lines of a comparison report."""
    return reports.select(
        F.format_string(
            "- %s: `%s` (%s)",
            F.col("model"),
            F.col("path"),
            F.when(F.col("status") == "missing", "missing").otherwise("found"),
        ).alias("line")
    )


def report_rows(reports: DataFrame) -> DataFrame:
    """Wide metric rows ``(model, split, metrics...)`` of the blocks that the reports hold."""
    blocks = F.array(
        *[
            F.struct(F.lit(name).alias("split"), F.col(f"report.{name}").alias("block"))
            for name in ("train", "val", "test", "overall")
        ]
    )
    cells = reports.select("model", F.explode(blocks).alias("b")).filter(F.size("b.block") > 0)
    values = [F.try_element_at("b.block", F.lit(m)).alias(m) for m in P.HEADLINE_METRICS]
    return cells.select("model", "b.split", *values)


def assembled_report(
    reports: DataFrame, models: list[str], external: str, classes: dict[str, str]
) -> DataFrame:
    """The whole comparison as Markdown ``(line_no, line)``: a title, the test metrics of ``models``, the
    external benchmark, a table of classes for each ``model: field`` of ``classes`` that has one, and
    the files read. ``reports`` comes from ``read_metrics_json``; the tables are class-sized.
    """
    from seqtables.operators.metrics import comparison_table

    spark = reports.sparkSession
    rows = report_rows(reports)
    parts: list[DataFrame] = []

    def text(*lines: str) -> DataFrame:
        return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")

    def add(lines: DataFrame) -> None:
        parts.append(lines.select(F.lit(len(parts)).alias("part"), F.col("line_no").cast("long"), "line"))

    add(text("# Comparison report", "", "## Test metrics", ""))
    add(comparison_markdown(comparison_table([rows], models)))
    add(text("", "## External benchmark", ""))
    add(benchmark_wording(reports, external).select(F.lit(0).alias("line_no"), "line"))
    held = rows.filter(F.col("model") == external)
    shown = comparison_markdown(comparison_table([held], [external], "overall"))
    benchmark = shown.unionByName(text("").select(F.lit(-1).alias("line_no"), "line"))
    known = reports.filter((F.col("model") == external) & F.col("report").isNotNull()).select("model")
    add(benchmark.join(known.limit(1)).select("line_no", "line"))
    for model, field in classes.items():
        table = class_markdown(reports, model, field)
        title = text("", f"## {model}, by class", "").select((F.col("line_no") - 3).alias("line_no"), "line")
        present = table.select(F.lit(1).alias("one")).limit(1)
        add(title.join(present).select("line_no", "line").unionByName(table))
    add(text("", "## Files read", ""))
    add(files_consumed(reports).select(F.row_number().over(Window.orderBy("line")).alias("line_no"), "line"))
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    order = F.row_number().over(Window.orderBy("part", "line_no"))
    return whole.select((order - 1).cast("long").alias("line_no"), "line")


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
