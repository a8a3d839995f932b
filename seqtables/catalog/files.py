"""Catalog: file sources and sinks, each written from a table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.catalog.base import (
    CELLS,
    CLASS_NAMES,
    DOCS,
    PART_GROUPS,
    PROCESSED_LONG,
    RAW,
    docs,
    r6,
    raw_pages,
    registry,
    scored,
    table,
)
from seqtables.catalog.scoring import (
    CONFUSION,
    NAMES_SQL,
    OVERALL_COLS,
    PER_CLASS_COLS,
    RATES,
    rounded,
)
from seqtables.catalog.splitting import STRATIFIED, WORD_MAP
from seqtables.functions.annotations import map_external_labels
from seqtables.functions.common import bind
from seqtables.operators import metrics as M
from seqtables.operators import similarity as C
from seqtables.operators.calibrate import apply_class_params
from seqtables.operators.clean import normalize_columns
from seqtables.operators.splits import stratified_split
from seqtables.plans import prepare
from seqtables.catalog.learning import letter_encoder
from seqtables.plans.embed import embed_rows
from seqtables.session import scratch_path
from seqtables.sources import exchange as X
from seqtables.sources import reports as R
from seqtables.sources import store as E
from seqtables.sources import tables as T

Q, SQL, query = registry()


@query(
    f"""WITH {RAW} SELECT accession, length(sequence) AS n_letters, md5(sequence) AS sequence_hash,
    md5(subcellular_location) AS location_hash FROM raw"""
)
def raw_pages_tsv(spark, sf):
    """Result pages written as tab-separated text and read by column name."""
    path = scratch_path(spark, "pages")
    raw_pages(spark, sf).drop("ord").write.option("sep", "\t").option("header", True).csv(path)
    return normalize_columns(T.read_raw(spark, path)).select(
        "accession",
        F.length(F.coalesce("sequence", F.lit(""))).cast("bigint").alias("n_letters"),
        F.md5(F.coalesce("sequence", F.lit(""))).alias("sequence_hash"),
        F.md5("subcellular_location").alias("location_hash"),
    )


@query(
    f"""WITH {RAW} SELECT organism_id AS organism_name, count(*) AS n,
    CAST(sum(length(sequence)) AS BIGINT) AS letters, CAST(sum(ord) AS BIGINT) AS ids FROM raw GROUP BY 1"""
)
def raw_snapshot_csv(spark, sf):
    path = scratch_path(spark, "raw")
    raw = normalize_columns(raw_pages(spark, sf))
    T.write_raw(
        raw.select(
            "accession",
            "sequence",
            "subcellular_location",
            F.col("ord").cast("int").alias("organism_id"),
            F.col("organism_id").alias("organism_name"),
        ),
        path,
        "csv",
    )
    return T.read_raw_csv(spark, path).groupBy("organism_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("sequence")).alias("letters"),
        F.sum("organism_id").alias("ids"),
    )


@query(
    f"""WITH {PROCESSED_LONG} SELECT accession, count(*) AS n_labels, string_agg(label, '|'
    ORDER BY label) AS locations_str FROM kept GROUP BY accession"""
)
def processed_csv(spark, sf):
    path = scratch_path(spark, "processed")
    processed = prepare.prepare(raw_pages(spark, sf), ["ord"], PART_GROUPS)
    T.write_processed(processed, path, "csv")
    return T.read_processed(spark, path, "csv").select(
        "accession",
        F.size("locations").cast("bigint").alias("n_labels"),
        F.array_join("locations", "|").alias("locations_str"),
    )


@query(f"WITH {STRATIFIED} SELECT doc_id, lang || '|' || source AS labels, split FROM s WHERE split = 'val'")
def split_store(spark, sf):
    """Splits written by directory; loading one prunes the others."""
    path = scratch_path(spark, "splits")
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    rows = stratified_split(d, "lang", "doc_id")
    T.write_splits(
        rows.select("doc_id", F.array("lang", "source").alias("locations"), "split"), path
    )
    return T.load_split(spark, path, "val").select(
        "doc_id", F.array_join("locations", "|").alias("labels"), "split"
    )


@query(
    f"""WITH {DOCS} SELECT concat('d|D', CAST(doc_id AS VARCHAR), '|', source) AS id,
    length(sequence) AS n_letters, md5(sequence) AS h FROM docs"""
)
def fasta_round_trip(spark, sf):
    path = scratch_path(spark, "fasta")
    named = docs(spark, sf).select(
        F.concat(F.lit("d|D"), F.col("doc_id"), F.lit("|"), F.col("source"), F.lit(" doc of "), "lang").alias(
            "accession"
        ),
        F.regexp_replace("sequence", "(.{60})", "$1\n").alias("sequence"),
    )
    X.write_fasta(named, path)
    return X.read_fasta(spark, path).select(
        "id",
        F.length("sequence").cast("bigint").alias("n_letters"),
        F.md5("sequence").alias("h"),
    )


MAPPED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORD_MAP.items())


@query(
    f"""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS id, replace(p_name, ' ', '|') AS raw_locations,
     list_filter(list_transform(string_split(p_name, ' '), lambda w: CASE w {MAPPED} END),
      lambda m: m IS NOT NULL) AS m FROM part)
    SELECT id, raw_locations, array_to_string(list_filter(m, lambda v, i: list_position(m, v) = i),
     '|') AS labels FROM t"""
)
def label_tsv(spark, sf):
    path = scratch_path(spark, "labels")
    table(spark, sf, "part").select(
        F.col("p_partkey").cast("string"), F.replace(F.col("p_name"), F.lit(" "), F.lit("|"))
    ).write.option("sep", "\t").csv(path)
    return X.read_label_tsv(spark, path).select(
        "id",
        "raw_locations",
        F.array_join(map_external_labels(F.col("raw_locations"), WORD_MAP), "|").alias("labels"),
    )


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size > 40 THEN '' ELSE p_type END
    AS raw_locations FROM part"""
)
def prediction_csv(spark, sf):
    path = scratch_path(spark, "predictions")
    table(spark, sf, "part").select(
        F.col("p_partkey").alias("Protein_ID"),
        F.when(F.col("p_size") <= 40, F.col("p_type")).alias("Localizations"),
        F.col("p_name").alias("Signals"),
    ).write.option("header", True).csv(path)
    return X.read_prediction_csv(spark, path)


@query(
    """WITH looked AS (SELECT 'd|P' || doc_id || '|' || lang AS accession, md5(text) AS sequence,
     p_name FROM part JOIN documents ON doc_id = p_partkey),
    m AS (SELECT accession, sequence, list_filter(list_transform(string_split(p_name, ' '), lambda w:
     CASE w """
    + MAPPED
    + """ END), lambda x: x IS NOT NULL) AS m FROM looked)
    SELECT accession, sequence, array_to_string(m, '|') AS locations_str, 'ground_truth_labels'
     AS reference_type, (SELECT count(*) FROM part) AS n_source_rows FROM m WHERE len(m) > 0"""
)
def reference_set(spark, sf):
    """External layout on disk: sequences plus a label table keyed by bare accession."""
    root = scratch_path(spark, "reference")
    seqs = table(spark, sf, "documents").select(
        F.concat(F.lit("d|P"), F.col("doc_id"), F.lit("|"), "lang").alias("accession"),
        F.md5("text").alias("sequence"),
    )
    X.write_fasta(seqs, f"{root}/test.fasta")
    table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")), F.replace(F.col("p_name"), F.lit(" "), F.lit("|"))
    ).write.option("sep", "\t").csv(f"{root}/test_labels.tsv")
    rows, meta = X.load_reference_set(spark, root, WORD_MAP)
    return rows.select(
        "accession",
        "sequence",
        "locations_str",
        F.lit(meta["reference_type"]).alias("reference_type"),
        F.lit(meta["n_source_rows"]).cast("bigint").alias("n_source_rows"),
    )


@query(
    """WITH p AS (SELECT o_orderpriority || o_orderstatus AS rep, CAST(o_orderkey AS VARCHAR) AS m
     FROM orders), n AS (SELECT rep, count(*) AS n FROM p GROUP BY rep)
    SELECT m AS accession, n AS cluster_size FROM p JOIN n USING (rep)"""
)
def cluster_tsv(spark, sf):
    path = scratch_path(spark, "clusters")
    table(spark, sf, "orders").select(
        F.concat("o_orderpriority", "o_orderstatus"), F.col("o_orderkey").cast("string")
    ).write.option("sep", "\t").csv(path)
    numbered = C.read_cluster_numbers(X.read_cluster_tsv(spark, path), "ordinal")
    sizes = numbered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return numbered.join(sizes, "cluster_id").select("accession", "cluster_size")


@query(
    """SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN 0.0 ELSE
    CAST(event_type <> 'view' AS DOUBLE) END AS has_sp, CASE WHEN event_type IN ('error', 'click')
    THEN 0.0 ELSE round(value, 2) END AS sp_prob FROM events"""
)
def signal_peptide_results(spark, sf):
    path = scratch_path(spark, "signal")
    e = table(spark, sf, "events")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("# seq_"), F.col("event_id")))
        .when(F.col("event_type") == "click", F.concat(F.lit("seq_"), F.col("event_id"), F.lit("\tSP")))
        .otherwise(
            F.concat_ws(
                "\t",
                F.concat(F.lit("seq_"), F.col("event_id")),
                F.when(F.col("event_type") == "view", "OTHER").otherwise("SP"),
                F.col("value").cast("string"),
            )
        )
    )
    e.select(line.alias("value")).write.text(path)
    ids = e.select("event_id", F.concat(F.lit("seq_"), F.col("event_id")).alias("id"))
    out = X.with_tool_features(ids, X.read_signal_peptide_results(spark, path))
    return out.select("event_id", "has_sp", F.round("sp_prob", 2).alias("sp_prob"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(user_id % 4 AS DOUBLE) END
     AS n_helices, CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(user_id % 4 > 0 AS DOUBLE) END
     AS has_tm, CASE WHEN event_type = 'error' THEN 0.0 ELSE round(round(value, 2)
      / greatest(user_id, 1), 6) END AS tm_fraction FROM events"""
)
def transmembrane_results(spark, sf):
    path = scratch_path(spark, "tm")
    e = table(spark, sf, "events")
    e.filter("event_type <> 'error'").select(
        F.format_string(
            "seq_%d\tlen=%d\tExpAA=%.2f\tFirst60=0.0\tPredHel=%d\tTopology=o",
            F.col("event_id"),
            F.col("user_id"),
            F.col("value"),
            F.col("user_id") % 4,
        ).alias("value")
    ).write.text(path)
    ids = e.select("event_id", F.concat(F.lit("seq_"), F.col("event_id")).alias("id"))
    out = X.with_tool_features(ids, X.read_tm_results(spark, path))
    return out.select("event_id", "n_helices", "has_tm", r6("tm_fraction").alias("tm_fraction"))


@query(f"WITH {CONFUSION} SELECT {PER_CLASS_COLS} FROM conf")
def metrics_csv(spark, sf):
    """Metric tables written as JSON, CSV and text; the CSV is read back."""
    path = scratch_path(spark, "metrics")
    confused = M.confusion(scored(spark, sf))
    R.write_metrics(M.per_class_metrics(confused, CLASS_NAMES), M.overall_metrics(confused), path)
    schema = (
        "label_idx bigint, label string, precision double, recall double, f1 double, "
        "support bigint, predicted_positive bigint"
    )
    return rounded(spark.read.schema(schema).option("header", True).csv(f"{path}/per_class_csv"))


@query(
    f"""WITH {CONFUSION}, o AS (SELECT {OVERALL_COLS} FROM ({RATES} FROM conf))
    SELECT 'fitted' AS model, 'found' AS status, f1_macro, hamming_loss FROM o
    UNION ALL SELECT 'absent', 'missing', NULL, NULL UNION ALL SELECT 'broken', 'invalid', NULL, NULL"""
)
def metrics_json(spark, sf):
    path = scratch_path(spark, "reports")
    confused = M.confusion(scored(spark, sf))
    overall = M.overall_metrics(confused).drop("total_samples")
    overall.select(
        F.to_json(F.struct(F.struct(*overall.columns).alias("overall"))).alias("value")
    ).coalesce(1).write.text(f"{path}/fitted")
    overall.select(F.lit("{not json").alias("value")).coalesce(1).write.text(f"{path}/broken")
    found = R.read_metrics_json(
        spark,
        {"fitted": f"{path}/fitted/*.txt", "absent": f"{path}/absent", "broken": f"{path}/broken/*.txt"},
    )
    return found.select(
        "model",
        "status",
        *[r6(F.col("report.overall")[m]).alias(m) for m in ("f1_macro", "hamming_loss")],
    )


@query(
    f"""WITH {CONFUSION}, o AS (SELECT {OVERALL_COLS} FROM ({RATES} FROM conf))
    SELECT CAST(0 AS BIGINT) AS line_no, '| Model | {' | '.join(P.HEADLINE_METRICS)} |' AS line
    UNION ALL SELECT 1, '|---|{'|'.join(['---:'] * len(P.HEADLINE_METRICS))}|'
    UNION ALL SELECT 2, '| fitted | ' || {" || ' | ' || ".join(f"printf('%.3f', {m})" for m in P.HEADLINE_METRICS)}
     || ' |' FROM o
    UNION ALL SELECT 3, '| absent | {' | '.join(['not available'] * len(P.HEADLINE_METRICS))} |'"""
)
def comparison_markdown(spark, sf):
    overall = M.overall_metrics(M.confusion(scored(spark, sf)))
    report = overall.select(F.lit("fitted").alias("model"), F.lit("test").alias("split"), "*")
    lines = R.comparison_markdown(M.comparison_table([report], ["fitted", "absent"]))
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    f"""WITH {CONFUSION}, r AS ({RATES} FROM conf)
    SELECT CAST(0 AS BIGINT) AS line_no, '| Class | Precision | Recall | F1 | Support |' AS line
    UNION ALL SELECT 1, '|---|---:|---:|---:|---:|'
    UNION ALL SELECT label_idx + 2, printf('| %s | %.3f | %.3f | %.3f | %d |',
     {NAMES_SQL}[label_idx + 1], pr, re, f1, CAST(tp + fn AS BIGINT)) FROM r"""
)
def class_markdown(spark, sf):
    """Per-class section of a report read back from JSON."""
    path = scratch_path(spark, "class-report")
    table_ = M.per_class_metrics(M.confusion(scored(spark, sf)), CLASS_NAMES)
    values = ("precision", "recall", "f1", "support")
    entry = F.struct("label", F.struct(*[F.col(v).cast("double").alias(v) for v in values]).alias("m"))
    classes = F.map_from_entries(
        F.transform(
            F.array_sort(F.collect_list(F.struct("label_idx", entry.alias("e")))), lambda x: x["e"]
        )
    )
    table_.agg(classes.alias("per_class")).select(
        F.to_json(F.struct("per_class")).alias("value")
    ).coalesce(1).write.text(path)
    found = R.read_metrics_json(spark, {"fitted": f"{path}/*.txt"})
    lines = R.class_markdown(found, "fitted", "per_class")
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    f"""WITH {DOCS}, keyed AS (SELECT sequence, sha256(concat_ws('|', 'letters', 'mean', '1024', sequence)) AS emb_key,
     count(*) AS n_rows FROM docs GROUP BY sequence),
    letters AS (SELECT emb_key, ascii(unnest(string_split(substr(sequence, 1, 1024), ''))) % 64 AS d FROM keyed
     WHERE sequence <> ''),
    cells AS (SELECT emb_key, d, count(*) AS n FROM letters GROUP BY 1, 2)
    SELECT emb_key, n_rows, CAST(64 AS BIGINT) AS dim, coalesce(string_agg(d || ':' || n, ',' ORDER BY d), '') AS counts
    FROM keyed LEFT JOIN cells USING (emb_key) GROUP BY emb_key, n_rows"""
)
def embedding_store(spark, sf):
    """Half of the sequences are stored first; the second call encodes the others only. Vectors as counts."""
    path = scratch_path(spark, "embeddings")
    rows = docs(spark, sf)

    def encode(new):
        return embed_rows(new, letter_encoder)

    E.embedding_store(rows.filter(F.col("lang") == "en"), encode, path, "letters")
    out, _ = E.embedding_store(rows, encode, path, "letters")
    size = F.least(F.length("sequence"), F.lit(1024))
    whole = bind(
        size,
        lambda n: F.transform(
            "embedding", lambda v, i: F.struct(i.alias("d"), F.round(v * n).cast("bigint").alias("n"))
        ),
    )
    shown = F.transform(F.filter(whole, lambda c: c["n"] > 0), lambda c: F.concat_ws(":", c["d"], c["n"]))
    return out.groupBy("emb_key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("embedding")).cast("bigint").alias("dim"),
        F.max(F.array_join(shown, ",")).alias("counts"),
    )


@query(
    f"""WITH {CELLS}, t AS (SELECT unnest(range(0, 10)) AS label_idx),
    d AS (SELECT cells.id, label_idx, CASE WHEN 1.0 / (1.0 + exp(-(z / CAST(1.0 + 0.1 * label_idx
     AS DOUBLE)))) >= CAST(0.4 + 0.02 * label_idx AS DOUBLE) THEN 1 ELSE 0 END AS pred
     FROM cells JOIN t USING (label_idx))
    SELECT id, string_agg(CAST(pred AS VARCHAR), '' ORDER BY label_idx) AS preds FROM d GROUP BY id"""
)
def stored_class_params(spark, sf):
    """Thresholds and temperatures saved, loaded and applied."""
    path = scratch_path(spark, "params")
    rows = scored(spark, sf)
    classes = rows.select(F.posexplode("y").alias("label_idx", "_")).select("label_idx").distinct()
    R.save_class_params(
        classes.withColumn("threshold", F.expr("cast(0.4 + 0.02 * label_idx as double)")),
        f"{path}/thresholds",
    )
    R.save_class_params(
        classes.withColumn("temperature", F.expr("cast(1.0 + 0.1 * label_idx as double)")),
        f"{path}/temperatures",
    )
    out = apply_class_params(
        rows,
        len(CLASS_NAMES),
        R.load_class_params(spark, f"{path}/thresholds", "threshold"),
        R.load_class_params(spark, f"{path}/temperatures", "temperature"),
    )
    return out.select("id", F.array_join(F.col("preds").cast("array<string>"), "").alias("preds"))
