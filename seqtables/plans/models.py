"""Per-class classifiers: fit, score, calibrate, evaluate, store."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.annotations import multi_hot
from seqtables.functions.scores import rank_predictions
from seqtables.operators.calibrate import apply_class_params, calibrate
from seqtables.operators.metrics import (
    confusion,
    label_array,
    overall_metrics,
    per_class_metrics,
)
from seqtables.operators.pooling import aggregate_chunks, explode_chunks
from seqtables.plans.boosting import (
    BoostedTrees,
    boosted_logits,
    fit_boosted,
    load_trees,
    save_trees,
)
from seqtables.plans.features import FeatureModel
from seqtables.plans.linear import (
    LinearModel,
    fit_linear,
    gradient_norms,
    linear_logits,
    load_linear,
    save_linear,
)
from seqtables.session import stored_table
from seqtables.sources.reports import load_class_params, save_class_params

# A class seen with one value only is predicted as that value, far from the decision border.
CONSTANT_LOGIT = 20.0


@dataclass
class Scorer:
    """One model (or constant) per class with optional per-class parameters.

    With a fitted ``stage``, its array of external features follows the vector of every row.
    """

    labels: list[str]
    models: list[object]
    thresholds: DataFrame | None = None
    temperatures: DataFrame | None = None
    meta: dict = field(default_factory=dict)
    stage: FeatureModel | None = None


def _class_sizes(df: DataFrame, y: str) -> dict[int, tuple[int, int]]:
    """(positives, rows) per class index; one row per class reaches the driver."""
    rows = (
        df.select(F.posexplode(y).alias("c", "v"))
        .groupBy("c")
        .agg(F.sum(F.col("v").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return {r["c"]: (r["pos"], r["n"]) for r in rows}


def constants(sizes: Mapping[int, tuple[int, int]], labels: Sequence[str]) -> dict[int, float]:
    """The logit of every class that training rows show with one value only."""
    found = {}
    for c in range(len(labels)):
        positives, n = sizes.get(c, (0, 0))
        if positives in (0, n):
            found[c] = CONSTANT_LOGIT if positives else -CONSTANT_LOGIT
    return found


def probe_weights(
    sizes: Mapping[int, tuple[int, int]], balanced: bool = True
) -> dict[int, tuple[float, float]]:
    """Weights of positives and negatives of every class that has both."""
    both = {c: (p, n) for c, (p, n) in sizes.items() if 0 < p < n}
    if not balanced:
        return {c: (1.0, 1.0) for c in both}
    return {c: (n / (2.0 * p), n / (2.0 * (n - p))) for c, (p, n) in both.items()}


def linear_probe(
    train: DataFrame,
    labels: Sequence[str],
    c: float = 1.0,
    max_iter: int = 1000,
    balanced: bool = True,
    features: str = "features",
    y: str = "y",
) -> Scorer:
    """L2 logistic regression per class with balanced class weights, all classes in one fit."""
    sizes = _class_sizes(train, y)
    fixed = constants(sizes, labels)
    weights = {i: w for i, w in probe_weights(sizes, balanced).items() if i < len(labels)}
    found = fit_linear(train, weights, c, max_iter, features=features, y=y) if weights else {}
    return Scorer(list(labels), [fixed[i] if i in fixed else found[i] for i in range(len(labels))])


def probe_gradients(
    train: DataFrame, scorer: Scorer, c: float = 1.0, balanced: bool = True, y: str = "y"
) -> DataFrame:
    """``(label, gradient)``: the largest part of the gradient a row that each fitted class has left."""
    models = {i: m for i, m in enumerate(scorer.models) if isinstance(m, LinearModel)}
    weights = probe_weights(_class_sizes(train, y), balanced)
    norms = gradient_norms(train, models, {i: weights[i] for i in models}, c, y=y)
    return norms.select(
        F.element_at(label_array(scorer.labels), F.col("label_idx") + 1).alias("label"), "gradient"
    )


def boosted_trees(
    train: DataFrame,
    labels: Sequence[str],
    n_trees: int = 300,
    depth: int = 6,
    rate: float = 0.1,
    features: str = "features",
    y: str = "y",
    **limits,
) -> Scorer:
    """Gradient-boosted trees per class; positives weigh max(1, negatives / positives)."""
    sizes = _class_sizes(train, y)
    fixed = constants(sizes, labels)
    weights = {
        i: max(1.0, (n - p) / p) for i, (p, n) in sizes.items() if i < len(labels) and i not in fixed
    }
    found: dict = {}
    if weights:
        found = fit_boosted(
            train, weights, len(labels), n_trees, depth, rate, features=features, y=y, **limits
        )
    return Scorer(list(labels), [fixed[i] if i in fixed else found[i] for i in range(len(labels))])


def add_logits(df: DataFrame, scorer: Scorer, features: str = "features") -> DataFrame:
    """Add the ``logits`` array, one entry per class."""
    rows, inputs = df, F.col(features)
    if scorer.stage is not None:
        rows = scorer.stage.transform(df)
        inputs = F.concat(inputs.cast("array<double>"), F.col(scorer.stage.getOrDefault("outputCol")))
    place: dict[int, Column] = {}
    for kind, column, score in (
        (LinearModel, "_linear", linear_logits),
        (BoostedTrees, "_trees", boosted_logits),
    ):
        own = [i for i, m in enumerate(scorer.models) if isinstance(m, kind)]
        if own:
            rows = rows.withColumn(column, score([scorer.models[i] for i in own], inputs))
            place.update({c: F.get(column, F.lit(i)) for i, c in enumerate(own)})
    cells = [place.get(c, F.lit(m) if isinstance(m, float) else None) for c, m in enumerate(scorer.models)]
    return rows.select(*df.columns, F.array(*cells).alias("logits"))


def decide(
    scored: DataFrame, scorer: Scorer, calibrated: bool = True, threshold: float = P.THRESHOLD
) -> DataFrame:
    """Logits -> probs, class thresholds, preds."""
    return apply_class_params(
        scored,
        len(scorer.labels),
        scorer.thresholds if calibrated else None,
        scorer.temperatures if calibrated else None,
        threshold,
    )


def rank(
    scored: DataFrame,
    scorer: Scorer,
    top_k: int = P.TOP_K,
    threshold: float = P.THRESHOLD,
    calibrated: bool = True,
) -> DataFrame:
    """Add the ranked ``predictions`` of every row."""
    return decide(scored, scorer, calibrated, threshold).withColumn(
        "predictions",
        rank_predictions(
            F.col("probs"), label_array(scorer.labels), F.col("class_thresholds"), top_k
        ),
    )


def score_batch(
    df: DataFrame, scorer: Scorer, features: str = "features", **kwargs
) -> DataFrame:
    """Features -> logits -> calibrated probabilities -> ranked predictions."""
    return rank(add_logits(df, scorer, features), scorer, **kwargs)


def score_long(
    df: DataFrame,
    scorer: Scorer,
    encode: Callable[[DataFrame], DataFrame],
    window: int,
    overlap: int = 128,
    key: str = "id",
    sequence: str = "sequence",
    strategy: str = "mean",
    **kwargs,
) -> DataFrame:
    """Chunk, score every chunk, combine per sequence, rank.

    ``encode`` adds ``features`` to rows with ``chunk_sequence`` and keeps their columns.
    """
    chunks = explode_chunks(df.select(key, sequence), sequence, window, overlap)
    scored = add_logits(encode(chunks), scorer)
    return rank(aggregate_chunks(scored, len(scorer.labels), strategy, key), scorer, **kwargs)


def calibrated_scorer(scorer: Scorer, val: DataFrame, features: str = "features") -> Scorer:
    """The scorer with temperatures and thresholds fitted on validation rows."""
    temperatures, thresholds = calibrate(add_logits(val, scorer, features))
    return Scorer(scorer.labels, scorer.models, thresholds, temperatures, scorer.meta, scorer.stage)


def evaluate(
    df: DataFrame,
    scorer: Scorer,
    features: str = "features",
    calibrated: bool = False,
    threshold: float = P.THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(overall, per class); fixed threshold and raw probabilities unless ``calibrated``."""
    scored = decide(add_logits(df, scorer, features), scorer, calibrated, threshold)
    confused = confusion(scored)
    return overall_metrics(confused), per_class_metrics(confused, scorer.labels)


def evaluate_splits(df: DataFrame, scorer: Scorer, **kwargs) -> DataFrame:
    """Overall metrics per value of ``split`` from one scored pass."""
    scored = decide(add_logits(df, scorer), scorer, calibrated=kwargs.get("calibrated", False))
    return overall_metrics(confusion(scored, ["split"]), ["split"])


def external_benchmark(
    reference: DataFrame,
    scorer: Scorer,
    encode: Callable[[DataFrame], DataFrame],
    reference_type: str = "ground_truth_labels",
) -> tuple[DataFrame, DataFrame]:
    """(overall with the rows used and skipped, per class) on reference rows.

    ``reference`` has ``accession, sequence, locations``. Rows without a sequence or without a location
    the scorer knows are skipped and counted in the pass that scores the others. The prediction of a
    row is its ranked list, as a user of the scorer would see it.
    """
    sequence = F.coalesce(F.col("sequence"), F.lit(""))
    missing = F.length(sequence) == 0
    unmapped = ~F.coalesce(F.arrays_overlap("locations", label_array(scorer.labels)), F.lit(False))
    counts = Observation("external benchmark")
    told = [
        F.count(F.lit(1)).alias("n_source_rows"),
        F.count_if("_missing").alias("n_skipped_missing_sequence"),
        F.count_if(~F.col("_missing") & F.col("_unmapped")).alias("n_skipped_unmapped_labels"),
    ]
    marked = reference.withColumn("_missing", missing).withColumn("_unmapped", unmapped)
    seen = marked.observe(counts, *told)
    usable = seen.filter(~F.col("_missing") & ~F.col("_unmapped")).drop("_missing", "_unmapped")
    ranked = score_batch(encode(usable), scorer)
    names = F.transform("predictions", lambda p: p["location"])
    scored = ranked.select(
        multi_hot(names, scorer.labels).alias("preds"),
        multi_hot(F.col("locations"), scorer.labels).alias("y"),
    )
    confused = stored_table(confusion(scored), "benchmark-counts")
    # Nothing is observed where adaptive execution finds no rows to score.
    skipped = marked.agg(*told).first().asDict() if confused.isEmpty() else counts.get
    overall = overall_metrics(confused).withColumns(
        {
            "n_samples": F.col("total_samples"),
            "reference_type": F.lit(reference_type),
            **{name: F.lit(value).cast("bigint") for name, value in skipped.items()},
        }
    )
    return overall, per_class_metrics(confused, scorer.labels)


@dataclass
class Variant:
    """A named run: ``run(params, folder)`` returns its one-row overall metrics or None.

    ``folder`` is the run's own; what it leaves there counts once the ledger names the folder.
    """

    params: Mapping
    run: Callable[[Mapping, str], DataFrame | None]

    def key(self) -> str:
        told = json.dumps(dict(self.params), sort_keys=True, default=str)
        return hashlib.sha256(told.encode()).hexdigest()


LEDGER = (
    "tag string, key string, status string, seconds double, error string, folder string, "
    "finished_at timestamp, " + ", ".join(f"{m} double" for m in P.HEADLINE_METRICS)
)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last row of every run; empty if nothing ran yet."""
    try:
        rows = spark.read.schema(LEDGER).parquet(f"{path.rstrip('/')}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)
    names = [f.name for f in rows.schema]
    last = F.max_by(F.struct(*names), F.struct("finished_at", "folder")).alias("r")
    return rows.groupBy("tag", "key").agg(last).select("r.*")


def run_matrix(spark: SparkSession, variants: Mapping[str, Variant], path: str) -> DataFrame:
    """Run the variants that have not ended well yet; the ledger's last row of each one.

    A run is known by its tag and the hash of its parameters, so a second call skips what is done
    and repeats failures and changed variants. Every attempt has a folder of its own, and its row is
    appended when it ends: an attempt cut off in between leaves no row. A failure is recorded and
    the next variant runs.
    """
    root = path.rstrip("/")
    done = {
        (r["tag"], r["key"])
        for r in ledger(spark, root).filter("status <> 'failed'").select("tag", "key").collect()
    }
    for tag, variant in variants.items():
        key = variant.key()
        if (tag, key) in done:
            continue
        folder = f"{root}/runs/{tag}-{key[:12]}-{uuid.uuid4().hex[:8]}"
        start = time.monotonic()
        metrics: dict = {}
        error = None
        try:
            frame = variant.run(variant.params, folder)
            row = None if frame is None else frame.first()
            metrics = {} if row is None else row.asDict()
            status = "ok" if metrics else "ok_no_metrics"
        except Exception as err:  # a failed variant is a result
            status, error = "failed", f"{type(err).__name__}: {err}"
        values = [metrics.get(m) for m in P.HEADLINE_METRICS]
        record = (tag, key, status, time.monotonic() - start, error, folder, None, *values)
        spark.createDataFrame([record], LEDGER).withColumn(
            "finished_at", F.current_timestamp()
        ).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    wanted = spark.createDataFrame([(t, v.key()) for t, v in variants.items()], "tag string, key string")
    return ledger(spark, root).join(F.broadcast(wanted), ["tag", "key"], "left_semi")


def best_runs(runs: DataFrame, k: int = 3, metric: str = "f1_macro") -> DataFrame:
    return runs.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), "tag").limit(k)


def matrix_report(runs: DataFrame, k: int = 3, metric: str = "f1_macro") -> DataFrame:
    """Markdown lines ``(line_no, line)`` of the runs, best ones first; the best ``k`` are marked."""

    def shown(c: str) -> Column:
        return F.when(F.col(c).isNull(), "—").otherwise(F.format_string("%.3f", F.col(c)))

    order = Window.orderBy(F.desc_nulls_last(metric), "tag")
    rows = runs.withColumn("n", F.row_number().over(order)).select(
        (F.col("n") + 1).alias("line_no"),
        F.concat_ws(
            " | ",
            F.concat(F.lit("| "), F.col("tag")),
            F.when((F.col("n") <= k) & F.col(metric).isNotNull(), "best").otherwise(""),
            "status",
            *[shown(m) for m in P.HEADLINE_METRICS],
        ).alias("line"),
    )
    head = ["| Run | Rank | Status | " + " | ".join(P.HEADLINE_METRICS) + " |"]
    head.append("|---|---|---|" + "|".join(["---:"] * len(P.HEADLINE_METRICS)) + "|")
    lines = runs.sparkSession.createDataFrame(list(enumerate(head)), "line_no int, line string")
    return lines.unionByName(rows.withColumn("line", F.concat("line", F.lit(" |"))))


def save_scorer(spark: SparkSession, scorer: Scorer, root: str, name: str) -> str:
    """Store a bundle below ``root`` and register it; returns its path.

    Every save has a folder of its own, and its row in the registry is written last. Readers start
    from the registry, so they see whole bundles only, whatever becomes of a save in between.
    """
    path = f"{root.rstrip('/')}/bundles/{name}-{uuid.uuid4().hex[:12]}"
    rows = []
    kinds = {LinearModel: "linear", BoostedTrees: "trees", float: "constant"}
    for i, (label, model) in enumerate(zip(scorer.labels, scorer.models)):
        kind = kinds[type(model)]
        rows.append((i, label, kind, model if kind == "constant" else None))
    for kind, store in ((LinearModel, save_linear), (BoostedTrees, save_trees)):
        own = {i: m for i, m in enumerate(scorer.models) if isinstance(m, kind)}
        if own:
            store(spark, own, f"{path}/{kinds[kind]}")
    if scorer.thresholds is not None:
        save_class_params(scorer.thresholds, f"{path}/thresholds")
    if scorer.temperatures is not None:
        save_class_params(scorer.temperatures, f"{path}/temperatures")
    if scorer.stage is not None:
        scorer.stage.write().save(f"{path}/stage")
        rows.append((len(rows), None, "stage", None))
    # The table of labels makes the folder a bundle.
    spark.createDataFrame(rows, "label_idx int, label string, kind string, constant double").coalesce(
        1
    ).write.parquet(f"{path}/labels")
    spark.range(1).select(
        F.lit(path).alias("path"), F.lit(name).alias("name"), F.current_timestamp().alias("saved_at")
    ).write.mode("append").parquet(f"{root.rstrip('/')}/registry")
    return path


def registered(spark: SparkSession, root: str) -> DataFrame:
    """``(path, name, saved_at)`` of every whole bundle."""
    try:
        return spark.read.schema("path string, name string, saved_at timestamp").parquet(
            f"{root.rstrip('/')}/registry"
        )
    except AnalysisException as err:
        raise FileNotFoundError(f"no bundle below {root}") from err


def newest_bundle(spark: SparkSession, root: str) -> str:
    """The bundle saved last; of equal times the one of the last path."""
    row = registered(spark, root).agg(F.max(F.struct("saved_at", "path")).alias("m")).first()
    if row["m"] is None:
        raise FileNotFoundError(f"no bundle below {root}")
    return row["m"]["path"]


def load_scorer(
    spark: SparkSession, root: str, path: str | None = None, last: str | None = None
) -> Scorer:
    """Load order: explicit path, the last one used, the newest registered."""
    chosen = path or last or newest_bundle(spark, root)
    try:
        table = spark.read.parquet(f"{chosen}/labels").orderBy("label_idx").collect()
    except AnalysisException as err:
        raise FileNotFoundError(f"no whole bundle at {chosen}") from err
    held = {r["kind"] for r in table}
    table = [r for r in table if r["kind"] != "stage"]
    known: dict[int, object] = {
        r["label_idx"]: float(r["constant"]) for r in table if r["kind"] == "constant"
    }
    for kind, read in (("linear", load_linear), ("trees", load_trees)):
        if kind in held:
            known.update(read(spark, f"{chosen}/{kind}"))
    return Scorer(
        [r["label"] for r in table],
        [known[r["label_idx"]] for r in table],
        load_class_params(spark, f"{chosen}/thresholds", "threshold"),
        load_class_params(spark, f"{chosen}/temperatures", "temperature"),
        {"path": chosen},
        FeatureModel.load(f"{chosen}/stage") if "stage" in held else None,
    )
