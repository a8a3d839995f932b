"""Multi-label metrics from one confusion table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.annotations import organism_name


def label_array(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def ratio(a: Column, b: Column) -> Column:
    """a/b, 0 when undefined."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(
    scored: DataFrame, groups: Sequence[str] = (), preds: str = "preds", y: str = "y"
) -> DataFrame:
    """tp, fp, fn per class index (and group), with the rows and exact rows of the group.

    Cells are combined before the shuffle, so at most classes x groups rows move per task.
    """
    cells = scored.select(
        *groups,
        (F.col(preds) == F.col(y)).cast("long").alias("_exact"),
        F.col(y).alias("_ys"),
        F.posexplode(preds).alias("label_idx", "_p"),
    ).withColumn("_y", F.get(F.col("_ys"), F.col("label_idx")))
    hit = F.col("_p") * F.col("_y")
    return cells.groupBy(*groups, "label_idx").agg(
        F.sum(hit.cast("long")).alias("tp"),
        F.sum((F.col("_p") - hit).cast("long")).alias("fp"),
        F.sum((F.col("_y") - hit).cast("long")).alias("fn"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("_exact").alias("n_exact"),
    )


def per_class_metrics(
    confused: DataFrame, labels: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confused.select(
        *groups,
        "label_idx",
        F.element_at(label_array(labels), F.col("label_idx") + 1).alias("label"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
        (tp + fp).alias("predicted_positive"),
    )


def overall_metrics(confused: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row of headline metrics per group; classes without support count as 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    cells = F.max("n_rows") * F.count(F.lit(1))
    return confused.groupBy(*groups).agg(
        F.avg(f1).alias("f1_macro"),
        ratio(2 * F.sum(tp), 2 * F.sum(tp) + F.sum(fp) + F.sum(fn)).alias("f1_micro"),
        ratio(F.sum(f1 * (tp + fn)), F.sum(tp + fn)).alias("f1_weighted"),
        F.avg(ratio(tp, tp + fp)).alias("precision_macro"),
        F.avg(ratio(tp, tp + fn)).alias("recall_macro"),
        (F.sum(fp + fn) / cells).alias("hamming_loss"),
        (F.max("n_exact") / F.max("n_rows")).alias("exact_match_ratio"),
        F.max("n_rows").alias("total_samples"),
    )


def melt_metrics(wide: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Wide metric row -> ``(ids..., metric, value)``."""
    values = [c for c in wide.columns if c not in ids]
    doubles = wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(list(ids), values, "metric", "value")


def cooccurrence(
    scored: DataFrame, labels: Sequence[str], preds: str = "preds", y: str = "y"
) -> DataFrame:
    """Counts of (true class, predicted class) pairs on the full class grid."""

    def on(col: str) -> Column:
        return F.filter(
            F.transform(F.col(col), lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull()
        )

    counts = (
        scored.select(on(preds).alias("_p"), F.explode(on(y)).alias("true_idx"))
        .select("true_idx", F.explode("_p").alias("pred_idx"))
        .groupBy("true_idx", "pred_idx")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    size = len(labels)
    names = label_array(labels)
    grid = scored.sparkSession.range(size * size).select(
        F.expr(f"cast(id div {size} as int)").alias("true_idx"),
        F.expr(f"cast(id % {size} as int)").alias("pred_idx"),
    )
    return grid.join(counts, ["true_idx", "pred_idx"], "left").select(
        F.element_at(names, F.col("true_idx") + 1).alias("true_label"),
        F.element_at(names, F.col("pred_idx") + 1).alias("pred_label"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def cooccurrence_matrix(grid: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The grid as one row per true class and one column per predicted class."""
    return grid.groupBy("true_label").pivot("pred_label", list(labels)).agg(F.sum("n"))


def grouped_confusion(
    scored: DataFrame, group: str, min_samples: int = 5, preds: str = "preds", y: str = "y"
) -> DataFrame:
    """Confusion per group of at least ``min_samples`` rows, with readable group names."""
    return (
        confusion(scored, [group], preds, y)
        .filter(F.col("n_rows") >= min_samples)
        .withColumn("group_name", organism_name(F.col(group)))
        .drop(group)
    )


def grouped_metrics(
    scored: DataFrame, group: str, labels: Sequence[str], min_samples: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(overall per group, per class per group); small groups are skipped by definition."""
    confused = grouped_confusion(scored, group, min_samples)
    return (
        overall_metrics(confused, ["group_name"]),
        per_class_metrics(confused, labels, ["group_name"]),
    )


def group_summary(scored: DataFrame, group: str, min_samples: int = 5) -> DataFrame:
    """Rows per kept group with the total rows and the number of kept groups on every row."""
    sizes = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n_samples"))
    totals = sizes.agg(
        F.struct(
            F.sum("n_samples").alias("rows"),
            F.count_if(F.col("n_samples") >= min_samples).alias("kept"),
        ).alias("t")
    ).scalar()
    return sizes.filter(F.col("n_samples") >= min_samples).select(
        organism_name(F.col(group)).alias("group_name"),
        "n_samples",
        totals["rows"].alias("total_samples"),
        totals["kept"].alias("n_groups"),
    )


def comparison_table(
    reports: Sequence[DataFrame], models: Sequence[str], split: str = "test"
) -> DataFrame:
    """One row per listed model x headline metric, as shown: three decimals or a placeholder.

    ``reports`` are wide metric rows with ``model`` and ``split``; a model without the split asked for
    is shown by its ``overall`` row.
    """
    if not reports:
        raise ValueError("no metric tables given")
    metrics = list(P.HEADLINE_METRICS)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    for m in metrics:
        if m not in rows.columns:
            rows = rows.withColumn(m, F.lit(None).cast("double"))
    listed = rows.sparkSession.range(len(models)).select(
        F.col("id").cast("int").alias("model_ord"),
        F.element_at(label_array(models), F.col("id").cast("int") + 1).alias("model"),
    )
    asked = F.col("split") == split
    named = ["model", F.lit(1).alias("_found"), *metrics]
    exact = rows.filter(asked).select(*named)
    spare = rows.filter((F.col("split") == "overall") & ~asked).select(*named)
    found = exact.unionByName(spare.join(exact.select("model").distinct(), "model", "left_anti"))
    shown = [
        F.when(F.col("_found").isNull(), "not available")
        .when(F.col(m).isNull(), "—")
        .otherwise(F.format_string("%.3f", F.col(m).cast("double")))
        .alias(m)
        for m in metrics
    ]
    return listed.join(found, "model", "left").select("model_ord", "model", *shown)
