"""Catalog: models, scoring plans and the request stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.catalog.base import (
    CLASS_NAMES,
    DOCS,
    N_CLASSES,
    SEQ,
    docs,
    hash_sql,
    r6,
    registry,
    table,
)
from seqtables.functions.keys import order_key
from seqtables.operators.clean import sequence_from_text
from seqtables.plans import embed as E
from seqtables.plans import models as M
from seqtables.plans.features import FeatureStage
from seqtables.session import scratch_path
from seqtables.sources import reports as R
from seqtables.streaming import scoring as S

Q, SQL, query = registry()


def examples(spark, sf):
    """Embeddings with one-hot truth and a seeded split by whole rows."""
    key = order_key(P.SEED, F.col("vec_id"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.transform(
            F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), lambda c: (F.col("label") == c).cast("int")
        ).alias("y"),
        F.when(key < "26", "test").when(key < "4d", "val").otherwise("train").alias("split"),
    )


# A scorer of fixed coefficients, so that SQL can repeat what is scored with it.
def coefficient(c: int, j: int) -> float:
    return ((7 * c + 3 * j) % 11 - 5) / 10


def fixed_scorer(spark, labels=CLASS_NAMES, dim: int = 64, calibrated: bool = True):
    models = [
        M.LinearModel(np.array([coefficient(c, j) for j in range(dim)]), (5 - c) / 20)
        for c in range(len(labels))
    ]
    params = [(c, 0.4 + c / 50, 0.5 + c / 10) for c in range(len(labels))]
    table_ = spark.createDataFrame(params, "label_idx int, threshold double, temperature double")
    if not calibrated:
        return M.Scorer(list(labels), models)
    return M.Scorer(
        list(labels),
        models,
        table_.select("label_idx", "threshold"),
        table_.select("label_idx", "temperature"),
    )


def logits_sql(source: str, n: int = N_CLASSES, value: str = "CAST(x[j + 1] AS DOUBLE)", dim: int = 64) -> str:
    """CTE ``logits (id, c, z)`` of rows ``(id, x)``."""
    return f"""logits AS (SELECT id, c, sum({value} * ((7 * c + 3 * j) % 11 - 5) / 10.0::DOUBLE)
     + (5 - c) / 20.0::DOUBLE AS z FROM {source}, (SELECT unnest(range({n})) AS c),
     (SELECT unnest(range({dim})) AS j) GROUP BY id, c)"""


def ranked_sql(labels) -> str:
    """CTEs from ``logits`` to ``ranked (id, k, location, confidence)``, calibrated."""
    return f"""probs AS (SELECT id, c, 1 / (1 + exp(-z / (0.5 + c / 10.0::DOUBLE))) AS p FROM logits),
    passing AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 4) DESC, c) AS k
     FROM probs WHERE p >= 0.4 + c / 50.0::DOUBLE),
    best AS (SELECT id, c, p, 1 AS k FROM probs QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, c) = 1),
    ranked AS (SELECT id, k, c, {list(labels)}[c + 1] AS location, round(p, 4) AS confidence
     FROM (SELECT id, c, p, k FROM passing WHERE k <= {P.TOP_K} UNION ALL
     SELECT id, c, p, k FROM best ANTI JOIN passing USING (id)))"""


LISTED = "string_agg(location || '=' || printf('%.4f', confidence), ',' ORDER BY k)"


def listed(column: str = "predictions"):
    """Ranked predictions as text."""
    return F.array_join(
        F.transform(
            column,
            lambda p: F.concat(p["location"], F.lit("="), F.format_string("%.4f", p["confidence"])),
        ),
        ",",
    )


EXAMPLES = """examples AS (SELECT vec_id AS id, embedding AS x, label, CASE WHEN k < '26' THEN 'test'
 WHEN k < '4d' THEN 'val' ELSE 'train' END AS split FROM (SELECT *, md5('42|' || vec_id) || '|' || vec_id
 AS k FROM embeddings))"""


def probe(rows, **kwargs):
    return M.linear_probe(rows.filter("split = 'train'"), CLASS_NAMES, **kwargs)


@query(
    """SELECT split, count(*) AS total_samples FROM (SELECT CASE WHEN k < '26' THEN 'test'
    WHEN k < '4d' THEN 'val' ELSE 'train' END AS split FROM (SELECT md5('42|' || vec_id) || '|'
    || vec_id AS k FROM embeddings)) GROUP BY split"""
)
def model_split_sizes(spark, sf):
    return examples(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("total_samples"))


@query()
def linear_probe(spark, sf):
    """Per-class logistic regression, metrics of the three splits."""
    rows = examples(spark, sf)
    return M.evaluate_splits(rows, probe(rows))


@query()
def linear_probe_classes(spark, sf):
    rows = examples(spark, sf)
    return M.evaluate(rows.filter("split = 'test'"), probe(rows))[1]


@query(f"SELECT unnest({CLASS_NAMES}) AS label, 0.0::DOUBLE AS gradient")
def linear_probe_gradient(spark, sf):
    """What a whole fit leaves of the gradient a row, of every class: the optimum's certificate."""
    train = examples(spark, sf).filter("split = 'train'")
    norms = M.probe_gradients(train, probe(train))
    return norms.select("label", F.round("gradient", 5).alias("gradient"))


@query()
def boosted_trees(spark, sf):
    """Per-class boosted trees with the operator's defaults on all training rows."""
    rows = examples(spark, sf)
    train = rows.filter("split = 'train'")
    return M.evaluate_splits(rows, M.boosted_trees(train, CLASS_NAMES))


FLAGS = ["A", "N", "R"]
STUMP_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query(
    f"""WITH cells AS (
        SELECT flag, f, CAST(v AS DOUBLE) AS v, CAST(l_returnflag = flag AS INTEGER) AS y
        FROM (SELECT l_returnflag, flag, unnest([{', '.join(STUMP_FEATURES)}]) AS v,
            unnest([0, 1, 2]) AS f FROM lineitem, (SELECT unnest({FLAGS}) AS flag))
    ), weights AS (
        SELECT flag, greatest(1.0::DOUBLE, (count(*) - sum(y))::DOUBLE / sum(y)) AS w
        FROM cells WHERE f = 0 GROUP BY flag
    ), sums AS (
        SELECT flag, f, v, sum(round((0.5 - y) * CASE y WHEN 1 THEN w ELSE 1 END * 1048576)) AS g,
            sum(round(0.25 * CASE y WHEN 1 THEN w ELSE 1 END * 1048576)) AS h
        FROM cells JOIN weights USING (flag) GROUP BY flag, f, v
    ), running AS (
        SELECT flag, f, v, sum(g) OVER up / 1048576 AS gl, sum(h) OVER up / 1048576 AS hl,
            sum(g) OVER (PARTITION BY flag, f) / 1048576 AS g, sum(h) OVER (PARTITION BY flag, f) / 1048576 AS h
        FROM sums WINDOW up AS (PARTITION BY flag, f ORDER BY v)
    ), gains AS (
        SELECT *, (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) / 2 AS gain
        FROM running WHERE hl >= 1 AND h - hl >= 1
    )
    SELECT flag, CAST(f AS INTEGER) AS feature, v AS cut, round(-0.1 * gl / (hl + 1), 6) AS left_value,
        round(-0.1 * (g - gl) / (h - hl + 1), 6) AS right_value
    FROM gains QUALIFY row_number() OVER (PARTITION BY flag ORDER BY gain DESC, f, v) = 1"""
)
def boosted_stumps(spark, sf):
    """The first tree of depth one for each return flag of the line items."""
    flag = F.col("l_returnflag")
    rows = table(spark, sf, "lineitem").select(
        F.array(*[F.col(c).cast("double") for c in STUMP_FEATURES]).alias("features"),
        F.array(*[(flag == x).cast("int") for x in FLAGS]).alias("y"),
    )
    scorer = M.boosted_trees(rows, FLAGS, n_trees=1, depth=1, bins=128)
    found = [
        (x, int(m.feature[0, 0]), float(m.cut[0, 0]), *map(float, m.leaf[0]))
        for x, m in zip(FLAGS, scorer.models)
    ]
    trees = spark.createDataFrame(
        found, "flag string, feature int, cut double, left_value double, right_value double"
    )
    return trees.withColumns({c: r6(c) for c in ("left_value", "right_value")})


@query()
def calibrated_evaluation(spark, sf):
    """Temperatures and thresholds from the validation split, used on the test split."""
    rows = examples(spark, sf)
    scorer = M.calibrated_scorer(probe(rows), rows.filter("split = 'val'"))
    return M.evaluate(rows.filter("split = 'test'"), scorer, calibrated=True)[0]


@query(
    f"""WITH {EXAMPLES}, {logits_sql('examples')}, {ranked_sql(CLASS_NAMES)}
    SELECT id, {LISTED} AS predictions FROM ranked GROUP BY id"""
)
def score_batch(spark, sf):
    """Ranked predictions of a calibrated scorer of fixed coefficients."""
    scored = M.score_batch(examples(spark, sf), fixed_scorer(spark))
    return scored.select("id", listed().alias("predictions"))


@query(
    f"""WITH {EXAMPLES}, joined AS (SELECT id, x, split, CASE WHEN id % 5 > 0 THEN n_chars END AS size,
     CASE WHEN lang IS NOT NULL THEN CAST(lang = 'en' AS INT) END AS has_sp
     FROM examples LEFT JOIN documents ON doc_id = id),
    stats AS (SELECT avg(size) AS mean, sqrt(var_pop(size) * count(size) / count(*)) AS std FROM joined
     WHERE split = 'train'),
    wide AS (SELECT id, list_concat(list_transform(x, lambda v: v::DOUBLE), [coalesce((size - mean) / std, 0),
     coalesce(has_sp, 0), 0]) AS x FROM joined, stats),
    {logits_sql('wide', dim=67)}, {ranked_sql(CLASS_NAMES)}
    SELECT id, {LISTED} AS predictions FROM ranked GROUP BY id"""
)
def score_with_features(spark, sf):
    """A stored scorer with a fitted feature stage: vectors and external columns of the same rows."""
    facts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("size"),
        (F.col("lang") == "en").cast("int").alias("has_sp"),
    )
    rows = examples(spark, sf).join(facts, "id", "left")
    # The tool of the last column did not run.
    stage = FeatureStage(["size"], ["has_sp", "sp_prob"]).fit(rows.filter("split = 'train'"))
    scorer = fixed_scorer(spark, dim=64 + stage.width)
    scorer.stage = stage
    root = scratch_path(spark, "bundles")
    M.save_scorer(spark, scorer, root, "features")
    scored = M.score_batch(rows, M.load_scorer(spark, root))
    return scored.select("id", listed().alias("predictions"))


@query(
    f"""WITH {EXAMPLES}, {logits_sql('examples')}, cells AS (SELECT split, c, id,
     CAST(1 / (1 + exp(-z / (0.5 + c / 10.0::DOUBLE))) >= 0.4 + c / 50.0::DOUBLE AS INT) AS pred,
     CAST(label = c AS INT) AS y FROM logits JOIN examples USING (id)),
    conf AS (SELECT split, c, sum(pred * y) AS tp, sum(pred * (1 - y)) AS fp, sum((1 - pred) * y) AS fn
     FROM cells GROUP BY split, c),
    exact AS (SELECT split, avg(CAST(e AS INT)) AS exact_match_ratio, count(*) AS total_samples FROM (
     SELECT split, id, bool_and(pred = y) AS e FROM cells GROUP BY split, id) GROUP BY split)
    SELECT split, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6)
     AS f1_macro, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro,
     round(any_value(exact_match_ratio), 6) AS exact_match_ratio, any_value(total_samples) AS total_samples
    FROM conf JOIN exact USING (split) GROUP BY split"""
)
def stored_scorer(spark, sf):
    """A bundle saved, found as the newest one, and used to score with its class parameters."""
    root = scratch_path(spark, "bundles")
    M.save_scorer(spark, fixed_scorer(spark, calibrated=False), root, "raw")
    M.save_scorer(spark, fixed_scorer(spark), root, "calibrated")
    found = M.evaluate_splits(examples(spark, sf), M.load_scorer(spark, root), calibrated=True)
    return found.select(
        "split", *[r6(c).alias(c) for c in ("f1_macro", "f1_micro", "exact_match_ratio")], "total_samples"
    )


TEXT_LABELS = ["quality", "toxic"]


def letter_encoder():
    """Shares of 64 letter codes: a plug-in encoder that SQL can repeat."""

    def encode(texts):
        out = []
        for t in texts:
            codes = np.frombuffer(t.encode("ascii"), dtype=np.uint8)
            counts = np.bincount(codes % 64, minlength=64).astype("float32")
            out.append(counts / max(1, len(codes)))
        return out

    return encode


def letter_features(rows, sequence="sequence"):
    """All columns and the letter shares as ``features``."""
    return E.embed_rows(rows, letter_encoder, sequence, "features", batch_size=256)


# Logits of letter shares: as many steps as letters, each by its code's coefficient.
def shares_sql(source: str, n: int) -> str:
    """CTE ``logits (id, c, z)`` of texts ``(id, s)``; a text without letters has the intercepts."""
    return f"""letters AS (SELECT id, length(s) AS len, ascii(unnest(string_split(s, ''))) % 64 AS j
     FROM {source} WHERE length(s) > 0), counted AS (SELECT id, j, (count(*)::FLOAT / any_value(len)::FLOAT)::DOUBLE AS v
     FROM letters GROUP BY id, j),
    logits AS (SELECT id, c, coalesce(sum(v * ((7 * c + 3 * j) % 11 - 5) / 10.0::DOUBLE), 0)
     + (5 - c) / 20.0::DOUBLE AS z FROM {source} LEFT JOIN counted USING (id),
     (SELECT unnest(range({n})) AS c) GROUP BY id, c)"""


@query(
    f"""WITH {DOCS}, cut AS (SELECT doc_id, sequence, length(sequence) AS n, unnest(range(0, CASE
     WHEN length(sequence) <= 1022 THEN 1 ELSE CAST(ceil((length(sequence) - 1022) / 894.0) AS BIGINT) + 1 END))
     AS chunk FROM docs), source AS (SELECT doc_id || '#' || chunk AS id, doc_id,
     substr(sequence, chunk * 894 + 1, 1022) AS s FROM cut
     WHERE n <= 1022 OR length(substr(sequence, chunk * 894 + 1, 1022)) >= 255), {shares_sql('source', 2)},
    mean AS (SELECT doc_id, c, avg(z) AS z FROM logits JOIN source USING (id) GROUP BY doc_id, c)
    SELECT doc_id AS id, c AS label_idx, round(z, 5) AS logit FROM mean"""
)
def score_long(spark, sf):
    """Long documents encoded and scored chunk by chunk, logits averaged."""
    scorer = fixed_scorer(spark, TEXT_LABELS)
    everything = docs(spark, sf).select(F.col("doc_id").alias("id"), "sequence")
    out = M.score_long(
        everything, scorer, lambda rows: letter_features(rows, "chunk_sequence"), 1022, 128
    )
    return out.select("id", F.posexplode("logits").alias("label_idx", "z")).select(
        "id", F.col("label_idx").cast("bigint").alias("label_idx"), F.round("z", 5).alias("logit")
    )


@query(
    f"""WITH {DOCS}, letters AS (SELECT doc_id, unnest(string_split(sequence, '')) AS c FROM docs),
    cells AS (SELECT doc_id, ascii(c) % 64 AS d, count(*) AS n FROM letters WHERE c <> '' GROUP BY 1, 2)
    SELECT doc_id, lang, CAST(64 AS BIGINT) AS dim, CAST(length(sequence) AS BIGINT) AS letters,
     coalesce(string_agg(d || ':' || n, ',' ORDER BY d), '') AS counts
    FROM docs LEFT JOIN cells USING (doc_id) GROUP BY doc_id, lang, sequence"""
)
def embed(spark, sf):
    """Every sequence encoded by a plug-in encoder beside its other columns; vectors as counts."""
    rows = E.embed_rows(docs(spark, sf), letter_encoder)
    whole = F.transform(
        "embedding", lambda v, i: F.struct(i.alias("d"), F.round(v * F.length("sequence")).cast("bigint").alias("n"))
    )
    shown = F.transform(F.filter(whole, lambda c: c["n"] > 0), lambda c: F.concat_ws(":", c["d"], c["n"]))
    return rows.select(
        "doc_id",
        "lang",
        F.size("embedding").cast("bigint").alias("dim"),
        F.length("sequence").cast("bigint").alias("letters"),
        F.array_join(shown, ",").alias("counts"),
    )


@query(
    f"""WITH {DOCS}, letters AS (SELECT doc_id, unnest(string_split(sequence, '')) AS c FROM docs
     WHERE length(sequence) > 0)
    SELECT doc_id, CAST(ascii(c) % 64 AS BIGINT) AS d, count(*) AS value FROM letters GROUP BY 1, 2"""
)
def embed_values(spark, sf):
    """The vectors of ``embed``: every cell that is not zero, times the length, as a whole number."""
    rows = letter_features(docs(spark, sf)).withColumn("n", F.length("sequence"))
    cells = rows.select("doc_id", "n", F.posexplode("features").alias("d", "v"))
    return cells.filter("v > 0").select(
        "doc_id",
        F.col("d").cast("bigint").alias("d"),
        F.round(F.col("v").cast("double") * F.col("n")).cast("bigint").alias("value"),
    )


CODE_3 = " + ".join(
    f"CAST(ascii(substr(sequence, i + {j}, 1)) - 64 AS BIGINT) * {27 ** (2 - j)}" for j in range(3)
)


@query(
    f"""WITH {DOCS}, kmers AS (SELECT doc_id, sequence, unnest(range(1, length(sequence) - 1)) AS i
     FROM docs), counts AS (SELECT doc_id, {hash_sql(CODE_3)} % 64 AS d, count(*) AS n FROM kmers
     GROUP BY 1, 2), unit AS (SELECT doc_id, d, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS v
     FROM counts)
    SELECT doc_id, CAST(d AS BIGINT) AS d, round(v, 4) AS value FROM unit"""
)
def kmer_embedding(spark, sf):
    out = E.kmer_embed(docs(spark, sf), "doc_id", "sequence")
    cells = out.select("doc_id", F.posexplode("embedding").alias("d", "v")).filter("v > 0")
    return cells.select(
        "doc_id",
        F.col("d").cast("bigint").alias("d"),
        F.round(F.col("v").cast("double"), 4).alias("value"),
    )


@query(
    f"""WITH source AS (SELECT conv_id || '-' || turn AS id, {SEQ} AS s, role FROM conversations),
    usable AS (SELECT * FROM source WHERE length(s) > 0 AND role IN ('assistant', 'user')),
    {shares_sql('usable', 2)}, {ranked_sql(TEXT_LABELS)},
    cells AS (SELECT u.id, c.c, CAST(c.c = CASE role WHEN 'assistant' THEN 0 ELSE 1 END AS INT) AS y,
     CAST(r.id IS NOT NULL AS INT) AS pred FROM usable u, (SELECT unnest(range(2)) AS c) c
     LEFT JOIN ranked r ON r.id = u.id AND r.c = c.c),
    conf AS (SELECT c, sum(pred * y) AS tp, sum(pred * (1 - y)) AS fp, sum((1 - pred) * y) AS fn FROM cells GROUP BY c)
    SELECT 'tool_predictions' AS reference_type, (SELECT count(*) FROM source) AS n_source_rows,
     (SELECT count(*) FROM source WHERE length(s) = 0) AS n_skipped_missing_sequence,
     (SELECT count(*) FROM source WHERE length(s) > 0 AND role NOT IN ('assistant', 'user')) AS n_skipped_unmapped_labels,
     (SELECT count(*) FROM usable) AS n_samples,
     round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS f1_macro FROM conf"""
)
def external_benchmark(spark, sf):
    """A fixed scorer measured on conversations by role; turns of other roles have no known label."""
    reference = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("accession"),
        sequence_from_text(F.col("text")).alias("sequence"),
        F.when(F.col("role") == "assistant", F.array(F.lit("quality")))
        .when(F.col("role") == "user", F.array(F.lit("toxic")))
        .otherwise(F.array(F.lit("unknown")))
        .alias("locations"),
    )
    scorer = fixed_scorer(spark, TEXT_LABELS)
    found = M.external_benchmark(reference, scorer, letter_features, "tool_predictions")[0]
    return found.select(
        "reference_type", "n_source_rows", "n_skipped_missing_sequence", "n_skipped_unmapped_labels",
        "n_samples", r6("f1_macro").alias("f1_macro"),
    )


def matrix_runs(spark, sf):
    """Runs of fixed scorers that differ in their class parameters; one fails, one has no metrics."""
    rows = examples(spark, sf).filter("split = 'test'")

    def run(params, folder):
        scorer = fixed_scorer(spark, calibrated=params["calibrated"])
        found = M.evaluate(rows, scorer, calibrated=True)[0]
        found.write.parquet(f"{folder}/overall")
        return found

    def broken(params, folder):
        raise ValueError("no such pooling")

    variants = {
        "calibrated": M.Variant({"calibrated": True}, run),
        "raw": M.Variant({"calibrated": False}, run),
        "broken": M.Variant({"pooling": "none"}, broken),
        "no_metrics": M.Variant({}, lambda params, folder: None),
    }
    path = scratch_path(spark, "matrix")
    M.run_matrix(spark, variants, path)
    # A second call repeats the failure only.
    return M.run_matrix(spark, variants, path)


def macro_sql(tag: str, p: str, cut: str) -> str:
    return f"""SELECT '{tag}' AS tag, 'ok' AS status, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN
     2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS f1_macro FROM (SELECT c, sum(pred * y) AS tp,
     sum(pred * (1 - y)) AS fp, sum((1 - pred) * y) AS fn FROM (SELECT c, CAST({p} >= {cut} AS INT) AS pred,
     CAST(label = c AS INT) AS y FROM logits JOIN examples USING (id) WHERE split = 'test') GROUP BY c)"""


RUNS = f"""{EXAMPLES}, {logits_sql('examples')}, runs AS (
    {macro_sql('calibrated', '1 / (1 + exp(-z / (0.5 + c / 10.0::DOUBLE)))', '0.4 + c / 50.0::DOUBLE')} UNION ALL
    {macro_sql('raw', '1 / (1 + exp(-z))', '0.5')} UNION ALL
    SELECT 'broken', 'failed', NULL UNION ALL SELECT 'no_metrics', 'ok_no_metrics', NULL)"""


@query(f"WITH {RUNS} SELECT * FROM runs")
def run_matrix(spark, sf):
    """Named variants with their status from the ledger."""
    return matrix_runs(spark, sf).select("tag", "status", r6("f1_macro").alias("f1_macro"))


@query(f"WITH {RUNS} SELECT tag, f1_macro FROM runs WHERE f1_macro IS NOT NULL ORDER BY f1_macro DESC, tag LIMIT 1")
def best_runs(spark, sf):
    """The best run by macro F1."""
    return M.best_runs(matrix_runs(spark, sf), 1).select("tag", r6("f1_macro").alias("f1_macro"))


OVERALL_OF = {
    "f1_macro": "avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END)",
    "f1_micro": "2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))",
    "f1_weighted": "sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END * (tp + fn)) / sum(tp + fn)",
    "precision_macro": "avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END)",
    "recall_macro": "avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END)",
    "hamming_loss": "sum(fp + fn) / (any_value(n) * count(*))::DOUBLE",
    "exact_match_ratio": "any_value(exact)",
}


@query(
    f"""WITH {EXAMPLES}, {logits_sql('examples')}, cells AS (SELECT id, c, CAST(1 / (1 + exp(-z)) >= 0.5 AS INT)
     AS pred, CAST(label = c AS INT) AS y FROM logits JOIN examples USING (id) WHERE split = 'test'),
    conf AS (SELECT c, sum(pred * y) AS tp, sum(pred * (1 - y)) AS fp, sum((1 - pred) * y) AS fn, count(*) AS n,
     (SELECT avg(CAST(e AS INT)) FROM (SELECT bool_and(pred = y) AS e FROM cells GROUP BY id)) AS exact
     FROM cells GROUP BY c),
    lines AS (SELECT 0 AS line_no, '| Model | {' | '.join(P.HEADLINE_METRICS)} |' AS line UNION ALL
     SELECT 1, '|---|{'|'.join(['---:'] * len(P.HEADLINE_METRICS))}|' UNION ALL
     SELECT 2, '| fixed probe | ' || {" || ' | ' || ".join(f"printf('%.3f', ({OVERALL_OF[m]})::DOUBLE)" for m in P.HEADLINE_METRICS)}
      || ' |' FROM conf UNION ALL
     SELECT 3, '| trained model | {' | '.join(['not available'] * len(P.HEADLINE_METRICS))} |')
    SELECT CAST(line_no AS INTEGER) AS line_no, line FROM lines"""
)
def comparison_report(spark, sf):
    """Markdown lines comparing a scorer with a missing model."""
    from seqtables.operators.metrics import comparison_table

    rows = examples(spark, sf)
    scored = M.evaluate_splits(rows, fixed_scorer(spark, calibrated=False))
    overall = scored.withColumn("model", F.lit("fixed probe"))
    lines = R.comparison_markdown(comparison_table([overall], ["fixed probe", "trained model"]))
    return lines.select(F.col("line_no").cast("int").alias("line_no"), "line")


@query(
    f"""WITH {DOCS}, told AS (SELECT doc_id, sequence, coalesce(CASE WHEN length(sequence) < 10 THEN 'too_short'
    WHEN length(sequence) > 5000 THEN 'too_long'
    WHEN NOT regexp_matches(sequence, '^[{P.RESIDUES}XU]+$') THEN 'invalid_residues'
    WHEN length(sequence) > 2048 THEN 'too_long_for_batch' END, 'scored') AS outcome FROM docs),
    usable AS (SELECT doc_id AS id, sequence AS s FROM told WHERE outcome = 'scored'),
    {shares_sql('usable', 10)}, {ranked_sql(CLASS_NAMES)},
    listed AS (SELECT id, {LISTED} AS predictions FROM ranked GROUP BY id)
    SELECT doc_id, outcome, CASE WHEN outcome = 'scored' THEN length(sequence) END AS sequence_length,
     predictions FROM told LEFT JOIN listed ON id = doc_id"""
)
def score_stream(spark, sf):
    """Documents as a file stream, scored with a stored bundle: ranked predictions and refusals."""
    root = scratch_path(spark, "stream")
    M.save_scorer(spark, fixed_scorer(spark), f"{root}/bundles", "fixed")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    # A table is a file or a folder of files; only as a pattern a stream takes both.
    source = S.read_requests(spark, f"{sf.rstrip('/')}/documents.parque[t]", schema, "*")
    requests = source.select(
        "doc_id", sequence_from_text(F.col("text")).alias("sequence")
    )
    stream = S.serve_stream(
        requests, f"{root}/bundles", letter_features, f"{root}/out", f"{root}/checkpoint"
    )
    stream.awaitTermination()
    accepted, rejected, _ = S.served(spark, f"{root}/out")
    return accepted.select(
        "doc_id",
        F.lit("scored").alias("outcome"),
        F.col("sequence_length").cast("bigint").alias("sequence_length"),
        listed().alias("predictions"),
    ).unionByName(
        rejected.select(
            "doc_id",
            F.col("error").alias("outcome"),
            F.lit(None).cast("bigint").alias("sequence_length"),
            F.lit(None).cast("string").alias("predictions"),
        )
    )
