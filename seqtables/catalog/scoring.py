"""Catalog: scored tables, metrics, losses and calibration on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.catalog.base import (
    CELLS,
    CLASS_NAMES,
    LOCATED,
    N_CLASSES,
    SCORED,
    count,
    joined,
    r6,
    registry,
    scored,
)
from seqtables.catalog.cleaning import located_parts
from seqtables.functions import scores as S
from seqtables.operators import calibrate as C
from seqtables.operators import labels as L
from seqtables.operators import losses as X
from seqtables.operators import metrics as M
from seqtables.operators.joins import align_scored
from seqtables.sources.reports import report_lines

Q, SQL, query = registry()

NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in CLASS_NAMES) + "]"


def text_list(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda v: printf('%.6f', round(v, 6) + 0.0)), ',')"


@query(
    f"""WITH {SCORED} SELECT id, {text_list('probs')} AS probs,
    array_to_string(preds, '') AS preds, array_to_string(y, '') AS y FROM scored"""
)
def probabilities(spark, sf):
    bits = [F.array_join(F.col(c).cast("array<string>"), "").alias(c) for c in ("preds", "y")]
    return scored(spark, sf).select("id", joined("probs").alias("probs"), *bits)


TEMPS = [0.5 + 0.25 * i for i in range(N_CLASSES)]


@query(
    f"""WITH {SCORED} SELECT id, {text_list(f"list_transform(logits, lambda z, i: 1.0 / (1.0 + "
    f"exp(-(z / CAST({TEMPS}[i] AS DOUBLE)))))")} AS probs FROM scored"""
)
def apply_temperature(spark, sf):
    calibrated = S.probabilities(F.col("logits"), S.double_array(TEMPS))
    return scored(spark, sf).select("id", joined(calibrated).alias("probs"))


CONFUSION = f"""{CELLS}, conf AS (SELECT label_idx, sum(pred * y) AS tp, sum(pred * (1 - y)) AS fp,
 sum((1 - pred) * y) AS fn, count(*) AS n_rows, sum(CAST(exact AS INT)) AS n_exact
 FROM cells GROUP BY label_idx)"""
PER_CLASS_COLS = f"""CAST(label_idx AS BIGINT) AS label_idx, {NAMES_SQL}[label_idx + 1] AS label,
 round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision,
 round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
 CAST(tp + fn AS BIGINT) AS support, CAST(tp + fp AS BIGINT) AS predicted_positive"""
OVERALL_COLS = """round(avg(f1), 6) AS f1_macro,
 round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro,
 round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS f1_weighted,
 round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro,
 round(CAST(sum(fp + fn) AS DOUBLE) / (max(n_rows) * count(*)), 6) AS hamming_loss,
 round(CAST(max(n_exact) AS DOUBLE) / max(n_rows), 6) AS exact_match_ratio,
 max(n_rows) AS total_samples"""
RATES = """SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END
 AS f1, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS pr,
 CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS re"""


def rounded(df, exact=("support", "predicted_positive", "total_samples", "label_idx", "n_rows")):
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        if kinds[c] == "double":
            out.append(r6(c).alias(c))
        elif c in exact:
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@query(f"WITH {CONFUSION} SELECT {PER_CLASS_COLS} FROM conf")
def per_class_metrics(spark, sf):
    return rounded(M.per_class_metrics(M.confusion(scored(spark, sf)), CLASS_NAMES))


@query(f"WITH {CONFUSION} SELECT {OVERALL_COLS} FROM ({RATES} FROM conf)")
def overall_metrics(spark, sf):
    return rounded(M.overall_metrics(M.confusion(scored(spark, sf))))


@query(
    f"""WITH {CONFUSION}, o AS (SELECT {OVERALL_COLS} FROM ({RATES} FROM conf))
    SELECT metric, value FROM (SELECT f1_macro, f1_micro, f1_weighted, precision_macro,
     recall_macro, hamming_loss, exact_match_ratio, CAST(total_samples AS DOUBLE) AS total_samples
     FROM o) UNPIVOT (value FOR metric IN (COLUMNS(*)))"""
)
def melt_metrics(spark, sf):
    return M.melt_metrics(overall_metrics(spark, sf))


@query(
    f"""WITH {SCORED}, grid AS (SELECT a, b FROM (SELECT unnest(range(0, 10)) AS a),
     (SELECT unnest(range(0, 10)) AS b)),
    n AS (SELECT a, b, count(*) AS n FROM scored, grid WHERE y[a + 1] = 1 AND preds[b + 1] = 1
     GROUP BY a, b)
    SELECT {NAMES_SQL}[a + 1] AS true_label, {NAMES_SQL}[b + 1] AS pred_label,
     coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (a, b)"""
)
def cooccurrence(spark, sf):
    return M.cooccurrence(scored(spark, sf), CLASS_NAMES)


@query(
    f"""WITH {SCORED}, grid AS (SELECT a, b FROM (SELECT unnest(range(0, 10)) AS a),
     (SELECT unnest(range(0, 10)) AS b)),
    n AS (SELECT a, b, count(*) AS n FROM scored, grid WHERE y[a + 1] = 1 AND preds[b + 1] = 1
     GROUP BY a, b)
    SELECT {NAMES_SQL}[a + 1] AS true_label, """
    + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN b = {i} THEN n END), 0) AS BIGINT) AS {c}"
        for i, c in enumerate(CLASS_NAMES)
    )
    + " FROM grid LEFT JOIN n USING (a, b) GROUP BY a"
)
def cooccurrence_matrix(spark, sf):
    return M.cooccurrence_matrix(cooccurrence(spark, sf), CLASS_NAMES)


NAMED = (
    "CASE organism_id "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in P.ORGANISM_NAMES.items())
    + " ELSE 'organism_' || organism_id END"
)
GROUPED = f"""{CELLS}, conf AS (SELECT {NAMED} AS group_name, label_idx, sum(pred * y) AS tp,
 sum(pred * (1 - y)) AS fp, sum((1 - pred) * y) AS fn, count(*) AS n_rows,
 sum(CAST(exact AS INT)) AS n_exact FROM cells GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query(f"WITH {GROUPED} SELECT group_name, {OVERALL_COLS} FROM ({RATES} FROM conf) GROUP BY group_name")
def grouped_overall_metrics(spark, sf):
    return rounded(M.grouped_metrics(scored(spark, sf), "organism_id", CLASS_NAMES)[0])


@query(f"WITH {GROUPED} SELECT group_name, {PER_CLASS_COLS} FROM conf")
def grouped_class_metrics(spark, sf):
    return rounded(M.grouped_metrics(scored(spark, sf), "organism_id", CLASS_NAMES)[1])


@query(
    f"""WITH {SCORED}, s AS (SELECT {NAMED} AS group_name, count(*) AS n_samples FROM scored
    GROUP BY 1), t AS (SELECT *, CAST(sum(n_samples) OVER () AS BIGINT) AS total_samples FROM s)
    SELECT *, count(*) OVER () AS n_groups FROM t WHERE n_samples >= 5"""
)
def group_summary(spark, sf):
    return M.group_summary(scored(spark, sf), "organism_id")


@query(
    f"""WITH {SCORED} SELECT organism_id, count(*) AS n, CAST(sum(y[1]) AS BIGINT) AS n_pos,
    round(sum(probs[1]), 4) AS p_sum FROM scored GROUP BY organism_id"""
)
def align_predictions(spark, sf):
    rows = scored(spark, sf)
    both = align_scored(rows.select("id", "probs", "organism_id"), rows.select("id", "y"))
    return both.groupBy(F.col("organism_id")).agg(
        count(),
        F.sum(F.col("y")[0]).alias("n_pos"),
        F.round(F.sum(F.col("probs")[0]), 4).alias("p_sum"),
    )


@query(
    f"""WITH {SCORED}, c AS (SELECT id, c AS pos, round(probs[c + 1], 4) AS conf, probs[c + 1] AS p
     FROM scored, (SELECT unnest(range(0, 10)) AS c)),
    ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, pos) AS k FROM c
     WHERE p >= 0.6),
    best AS (SELECT id, arg_min(pos, (-p, pos)) AS pos FROM c GROUP BY id),
    chosen AS (SELECT id, pos, conf, k FROM ok WHERE k <= 3 UNION ALL
     SELECT id, pos, conf, 1 FROM c JOIN best USING (id, pos) WHERE id NOT IN (SELECT id FROM ok))
    SELECT id, string_agg({NAMES_SQL}[pos + 1] || '=' || printf('%.4f', conf), ',' ORDER BY k)
     AS predictions FROM chosen GROUP BY id"""
)
def rank_predictions(spark, sf):
    ranked = S.rank_predictions(F.col("probs"), M.label_array(CLASS_NAMES), 0.6, 3)
    return scored(spark, sf).select(
        "id",
        F.array_join(
            F.transform(
                ranked,
                lambda p: F.concat(p["location"], F.lit("="), F.format_string("%.4f", p["confidence"])),
            ),
            ",",
        ).alias("predictions"),
    )


@query(
    f"""WITH {CELLS}, t AS (SELECT unnest(range(1, 20)) AS i),
    f AS (SELECT label_idx, i, sum(y) AS pos, sum(CASE WHEN p >= i * 0.05::DOUBLE THEN y ELSE 0 END)
     AS tp, count_if(p >= round(i * 0.05, 2)::DOUBLE) AS predicted FROM cells, t GROUP BY label_idx, i),
    r AS (SELECT label_idx, i, pos, CASE WHEN pos + predicted > 0 THEN 2.0 * tp / (pos + predicted)
     ELSE 0.0 END AS f1 FROM f),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label_idx ORDER BY f1 DESC, i) = 1)
    SELECT CAST(label_idx AS BIGINT) AS label_idx, CASE WHEN pos > 0 THEN round(i * 0.05, 6)::DOUBLE
     ELSE 0.5::DOUBLE END AS threshold, CASE WHEN pos > 0 THEN round(f1, 6) END AS f1 FROM b"""
)
def threshold_sweep(spark, sf):
    return rounded(C.threshold_sweep(scored(spark, sf)))


def bce_sql(z: str, y: str) -> str:
    return f"(greatest({z}, 0.0) - ({z}) * {y} + ln(1.0 + exp(-abs({z}))))"


@query(
    f"""WITH {CELLS} SELECT CAST(label_idx AS BIGINT) AS label_idx,
    round(avg({bce_sql("(z / CAST(" + str(TEMPS) + "[label_idx + 1] AS DOUBLE))", "y")}), 6) AS bce
    FROM cells GROUP BY label_idx"""
)
def bce_by_class(spark, sf):
    return rounded(X.bce_by_class(scored(spark, sf), TEMPS))


def temperature_sql(rounds: int = 6, points: int = 32) -> str:
    grid = list(P.TEMPERATURE_GRID)
    parts = [
        f"""b0 AS (SELECT label_idx, has, CAST({grid}[greatest(g - 1, 1)] AS DOUBLE) AS lo,
        CAST({grid}[least(g + 1, {len(grid)})] AS DOUBLE) AS hi FROM (SELECT label_idx,
        sum(pos) > 0 AS has, arg_min(g, (loss, g)) AS g FROM (SELECT label_idx, g, sum(y) AS pos,
        avg({bce_sql(f"(z / CAST({grid}[g] AS DOUBLE))", "y")}) AS loss FROM cells,
        (SELECT unnest(range(1, {len(grid) + 1})) AS g) GROUP BY label_idx, g) GROUP BY label_idx))"""
    ]
    for r in range(rounds):
        width = f"((hi - lo) / {points - 1})"
        parts.append(
            f"""b{r + 1} AS (SELECT label_idx, has, lo + {width} * greatest(g - 1, 0) AS lo,
            lo + {width} * least(g + 1, {points - 1}) AS hi FROM (SELECT label_idx, has, lo, hi,
            arg_min(g, (loss, g)) AS g FROM (SELECT label_idx, has, lo, hi, g,
            avg({bce_sql(f"(z / (lo + {width} * g))", "y")}) AS loss FROM cells JOIN b{r}
            USING (label_idx), (SELECT unnest(range(0, {points})) AS g)
            GROUP BY label_idx, has, lo, hi, g) GROUP BY label_idx, has, lo, hi))"""
        )
    return (
        f"WITH {CELLS}, {', '.join(parts)} SELECT CAST(label_idx AS BIGINT) AS label_idx, "
        f"round(CASE WHEN has THEN (lo + hi) / 2 ELSE 1.0 END, 4) AS temperature FROM b{rounds}"
    )


@query(temperature_sql())
def fit_temperatures(spark, sf):
    return C.fit_temperatures(scored(spark, sf)).select(
        F.col("label_idx").cast("bigint").alias("label_idx"),
        F.round("temperature", 4).alias("temperature"),
    )


@query(
    f"""WITH {CELLS}, t AS (SELECT label_idx, CASE WHEN label_idx < 5 THEN 0.3 + 0.05 * label_idx
     ELSE 0.5 END AS threshold, CASE WHEN label_idx >= 5 THEN 0.5 + 0.25 * label_idx ELSE 1.0 END
     AS temperature FROM (SELECT unnest(range(0, 10)) AS label_idx)),
    d AS (SELECT cells.id, label_idx, CASE WHEN 1.0 / (1.0 + exp(-(z / CAST(temperature AS DOUBLE))))
     >= CAST(threshold AS DOUBLE) THEN 1 ELSE 0 END AS pred FROM cells JOIN t USING (label_idx))
    SELECT id, string_agg(CAST(pred AS VARCHAR), '' ORDER BY label_idx) AS preds FROM d GROUP BY id"""
)
def apply_class_params(spark, sf):
    rows = scored(spark, sf)
    classes = rows.select(F.posexplode("y").alias("label_idx", "_")).select("label_idx").distinct()
    thresholds = classes.filter("label_idx < 5").select(
        "label_idx", F.expr("cast(0.3 + 0.05 * label_idx as double)").alias("threshold")
    )
    temperatures = classes.filter("label_idx >= 5").select(
        "label_idx", F.expr("cast(0.5 + 0.25 * label_idx as double)").alias("temperature")
    )
    out = C.apply_class_params(rows, N_CLASSES, thresholds, temperatures)
    return out.select("id", F.array_join(F.col("preds").cast("array<string>"), "").alias("preds"))


@query(
    f"""WITH {CELLS} SELECT CAST(label_idx AS BIGINT) AS label_idx, CAST(sum(y) AS BIGINT) AS n_pos,
    CAST(sum(1 - y) AS BIGINT) AS n_neg, round(greatest(1.0, CAST(sum(1 - y) AS DOUBLE)
     / greatest(1, sum(y))), 6) AS scale_pos_weight FROM cells GROUP BY label_idx"""
)
def scale_pos_weight(spark, sf):
    return rounded(L.scale_pos_weight(scored(spark, sf)))


ALPHA = [1.0 + 0.1 * i for i in range(N_CLASSES)]
FOCAL = f"""(pow(1.0 - (y * p + (1 - y) * (1.0 - p)), 2.0) * {bce_sql("z", "y")}
 * CAST({ALPHA}[label_idx + 1] AS DOUBLE))"""


@query(f"WITH {CELLS} SELECT round(avg({FOCAL}), 6) AS focal FROM cells")
def focal_loss(spark, sf):
    return rounded(X.focal_loss(scored(spark, sf), 2.0, ALPHA))


@query(
    f"""WITH {CELLS} SELECT id, CAST(label_idx AS BIGINT) AS label_idx, round({FOCAL}, 6) AS focal
    FROM cells"""
)
def focal_cells(spark, sf):
    return rounded(X.focal_loss(scored(spark, sf), 2.0, ALPHA, "none"))


PAIRS = {("Bolt", "Gear"): 1, ("Bolt", "Plate"): 1, ("Ring", "Gear"): 1, ("Economy", "Ring"): 3}
PAIRS_SQL = ", ".join(f"('{a}', '{b}', {d})" for (a, b), d in PAIRS.items())


@query(
    f"""WITH {LOCATED}, l AS (SELECT DISTINCT unnest(locations) AS label FROM located),
    pairs(pa, pb, d) AS (VALUES {PAIRS_SQL}),
    both_ways AS (SELECT pa, pb, d FROM pairs UNION ALL SELECT pb, pa, d FROM pairs),
    g AS (SELECT x.label AS a, y.label AS b, CASE WHEN x.label = y.label THEN 0
     ELSE coalesce(d, 2) END AS d FROM l x, l y LEFT JOIN both_ways ON pa = x.label AND pb = y.label)
    SELECT a, b, round(CAST(d AS DOUBLE) / max(d) OVER (), 6) AS dist FROM g"""
)
def distance_matrix(spark, sf):
    vocabulary = L.discover_labels(located_parts(spark, sf))
    return rounded(X.distance_matrix(vocabulary, X.distance_pairs(spark, PAIRS)))


CLASS_PAIRS = {
    (CLASS_NAMES[i], CLASS_NAMES[j]): 1 + (i * j) % 3
    for i in range(N_CLASSES)
    for j in range(i + 1, N_CLASSES)
    if (i + j) % 4
}
DISTANCES = X.distance_rows(CLASS_NAMES, CLASS_PAIRS)
DIST_SQL = str(DISTANCES)
PENALTY = f"""pen AS (SELECT p.id, p.label_idx, p.p * (1 - p.y) * sum(t.y
  * CAST({DIST_SQL}[t.label_idx + 1][p.label_idx + 1] AS DOUBLE)) / greatest(sum(t.y), 1) AS v
  FROM cells p JOIN cells t ON p.id = t.id GROUP BY p.id, p.label_idx, p.p, p.y)"""


@query(f"WITH {CELLS}, {PENALTY} SELECT round(avg(v), 6) AS hierarchical FROM pen")
def hierarchical_penalty(spark, sf):
    return rounded(X.hierarchical_penalty(scored(spark, sf), DISTANCES))


@query(
    f"""WITH {CELLS}, {PENALTY}, h AS (SELECT avg(v) AS v FROM pen),
    f AS (SELECT avg({FOCAL}) AS v FROM cells),
    a AS (SELECT avg({bce_sql("z", "y")}) AS v FROM cells WHERE label_idx < 2)
    SELECT round(f.v, 6) AS focal, round(h.v, 6) AS hierarchical, round(a.v, 6) AS aux,
     round(f.v + 0.1 * h.v + 0.2 * a.v, 6) AS loss FROM f, h, a"""
)
def combined_loss(spark, sf):
    rows = scored(spark, sf).select(
        "*", F.slice("logits", 1, 2).alias("aux_logits"), F.slice("y", 1, 2).alias("aux_y")
    )
    return rounded(X.combined_loss(rows, DISTANCES, alpha=ALPHA))


@query(
    f"""WITH {CONFUSION}, r AS ({RATES} FROM conf),
    o AS (SELECT avg(pr) AS pr, avg(re) AS re, avg(f1) AS f1, max(n_rows) AS n,
     CAST(max(n_exact) AS DOUBLE) / max(n_rows) AS em,
     CAST(sum(fp + fn) AS DOUBLE) / (max(n_rows) * 10) AS hl FROM r)
    SELECT 0 AS line_no, format('{{:<28}} {{:>10}} {{:>10}} {{:>10}} {{:>10}}', 'Class', 'Precision',
     'Recall', 'F1', 'Support') AS line
    UNION ALL SELECT 1, repeat('-', 70)
    UNION ALL SELECT label_idx + 2, format('{{:<28}} {{:>10.3f}} {{:>10.3f}} {{:>10.3f}} {{:>10d}}',
     {NAMES_SQL}[label_idx + 1], pr, re, f1, CAST(tp + fn AS BIGINT)) FROM r
    UNION ALL SELECT 12, repeat('-', 70)
    UNION ALL SELECT 13, format('{{:<28}} {{:>10.3f}} {{:>10.3f}} {{:>10.3f}} {{:>10d}}', 'Macro avg',
     pr, re, f1, n) FROM o
    UNION ALL SELECT 14, ''
    UNION ALL SELECT 15, format('Exact match ratio: {{:.3f}}', em) FROM o
    UNION ALL SELECT 16, format('Hamming loss: {{:.4f}}', hl) FROM o"""
)
def report_text(spark, sf):
    confused = M.confusion(scored(spark, sf))
    return report_lines(M.per_class_metrics(confused, CLASS_NAMES), M.overall_metrics(confused))


@query(
    f"""WITH {GROUPED}, o AS (SELECT group_name, {OVERALL_COLS} FROM ({RATES} FROM conf)
     GROUP BY group_name), m(model_ord, model) AS (VALUES (0, 'Homo sapiens'), (1, 'Mus musculus'),
     (2, 'Absent'))
    SELECT CAST(model_ord AS BIGINT) AS model_ord, model, """
    + ", ".join(
        f"CASE WHEN group_name IS NULL THEN 'not available' ELSE printf('%.3f', {m}) END AS {m}"
        for m in P.HEADLINE_METRICS
    )
    + " FROM m LEFT JOIN o ON group_name = model"
)
def comparison_table(spark, sf):
    overall = M.grouped_metrics(scored(spark, sf), "organism_id", CLASS_NAMES)[0]
    report = overall.withColumnRenamed("group_name", "model").withColumn("split", F.lit("test"))
    out = M.comparison_table([report], ["Homo sapiens", "Mus musculus", "Absent"])
    return out.withColumn("model_ord", F.col("model_ord").cast("bigint"))
