"""Catalog: cleaning, annotation and row-level sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.catalog.base import (
    DOCS,
    LOCATED,
    PART_GROUPS,
    PROCESSED_LONG,
    RAW,
    annotated_parts,
    count,
    docs,
    raw_pages,
    registry,
    table,
)
from seqtables.sources.tables import spread_scan
from seqtables.functions import annotations as A
from seqtables.functions import keys as K
from seqtables.functions import sequences as S
from seqtables.operators import clean as C
from seqtables.operators import joins as J
from seqtables.operators import labels as L
from seqtables.operators import profiles as R
from seqtables.plans.prepare import label_report, prepare

Q, SQL, query = registry()


@query(
    f"WITH {PROCESSED_LONG} SELECT label, count(*) AS n FROM kept GROUP BY label ORDER BY n DESC"
)
def labels_after_cleaning(spark, sf, min_samples=P.MIN_SAMPLES):
    """Flagship: raw pages to label counts after every cleaning step."""
    pages = raw_pages(spark, sf)
    return label_report(prepare(pages, ["ord"], PART_GROUPS, min_samples=min_samples))


@query(
    f"""WITH {PROCESSED_LONG} SELECT accession, string_agg(label, '|' ORDER BY label)
    AS locations_str, any_value(organism_id) AS organism_id FROM kept GROUP BY accession"""
)
def processed_records(spark, sf):
    return prepare(raw_pages(spark, sf), ["ord"], PART_GROUPS).select(
        "accession", "locations_str", "organism_id"
    )


@query(
    f"WITH {RAW} SELECT accession, ord, length(sequence) AS n_letters, "
    "md5(subcellular_location) AS location_hash, organism_id FROM raw"
)
def normalize_columns(spark, sf):
    return C.normalize_columns(raw_pages(spark, sf)).select(
        "accession",
        "ord",
        F.length("sequence").cast("bigint").alias("n_letters"),
        F.md5("subcellular_location").alias("location_hash"),
        "organism_id",
    )


@query(
    "SELECT event_id, user_id FROM events QUALIFY "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5"
)
def cap_per_source(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return C.cap_per_source(e, "user_id", ["ts", "event_id"], 5).select("event_id", "user_id")


@query(
    "SELECT event_id, event_type FROM events QUALIFY "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 1500"
)
def cap_large_sources(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return C.cap_per_source(e, "event_type", ["ts", "event_id"], 1500).select(
        "event_id", "event_type"
    )


@query(
    """SELECT kind, count(*) AS n, count(segment) AS n_segment FROM (
    SELECT 'customer' AS kind, c_mktsegment AS segment FROM customer UNION ALL
    SELECT 'supplier', NULL FROM supplier) GROUP BY kind"""
)
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment")
    )
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"))
    rows, _ = J.union_sources([c, s])
    return rows.groupBy("kind").agg(count(), F.count("segment").alias("n_segment"))


@query(
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"
)
def dedup_keep_first(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return C.dedup_keep_first(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    """SELECT lang, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL AND text <> '' GROUP BY lang"""
)
def drop_missing(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return C.drop_missing(rows, ["text", "quality"]).groupBy("lang").agg(count())


@query(
    f"WITH {LOCATED} SELECT p_partkey, array_to_string(raw, '|') AS raw_labels FROM located"
)
def parse_annotations(spark, sf):
    return annotated_parts(spark, sf).select(
        "p_partkey", F.array_join(A.parse_annotations(F.col("annotation")), "|").alias("raw_labels")
    )


@query(
    f"WITH {LOCATED} SELECT p_partkey, array_to_string(locations, '|') AS locations_str FROM located"
)
def map_to_groups(spark, sf):
    labels = A.map_to_groups(A.parse_annotations(F.col("annotation")), PART_GROUPS)
    return annotated_parts(spark, sf).select(
        "p_partkey", A.labels_to_string(labels).alias("locations_str")
    )


def located_parts(spark, sf):
    return C.with_locations(annotated_parts(spark, sf), "annotation", PART_GROUPS)


@query(
    f"WITH {LOCATED} SELECT locations[1] AS label, count(*) AS n FROM located "
    "WHERE len(locations) > 0 GROUP BY 1"
)
def single_label(spark, sf):
    rows = C.with_locations(annotated_parts(spark, sf), "annotation", PART_GROUPS, False)
    return L.label_counts(rows)


@query(
    f"""WITH {DOCS}, letters AS (SELECT doc_id, sequence, upper(regexp_replace(text, '[^A-Za-z]', '',
    'g')) AS plain FROM docs JOIN documents USING (doc_id))
    SELECT doc_id, CAST(length(sequence) BETWEEN 30 AND 2048 AND
     regexp_matches(sequence, '^[{P.RESIDUES}XU]+$') AS BIGINT) AS valid_mapped,
     CAST(length(plain) BETWEEN 30 AND 2048 AND
     regexp_matches(plain, '^[{P.RESIDUES}XU]+$') AS BIGINT) AS valid_plain FROM letters"""
)
def valid_sequences(spark, sf):
    plain = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    rows = spread_scan(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        S.is_valid_sequence(C.sequence_from_text(F.col("text"))).cast("bigint").alias("valid_mapped"),
        S.is_valid_sequence(plain).cast("bigint").alias("valid_plain"),
    )


@query(
    f"""WITH {DOCS} SELECT doc_id, coalesce(CASE WHEN length(sequence) < 10 THEN 'too_short'
    WHEN length(sequence) > 5000 THEN 'too_long'
    WHEN NOT regexp_matches(sequence, '^[{P.RESIDUES}XU]+$') THEN 'invalid_residues'
    WHEN length(sequence) > 2048 THEN 'too_long_for_batch' END, 'accepted') AS outcome FROM docs"""
)
def validate_requests(spark, sf):
    accepted, refused = C.validate_requests(docs(spark, sf))
    return accepted.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(
        refused.select("doc_id", F.col("error").alias("outcome"))
    )


@query(
    f"""WITH {DOCS} SELECT doc_id, length(substr(sequence, 1, 510)) AS n,
    md5(substr(sequence, 1, 510)) AS h FROM docs"""
)
def truncate(spark, sf):
    cut = S.truncate(F.col("sequence"), 512, 1024)
    return docs(spark, sf).select(
        "doc_id", F.length(cut).cast("bigint").alias("n"), F.md5(cut).alias("h")
    )


@query(
    f"""WITH {LOCATED} SELECT p_partkey, array_to_string(list_transform(
    ['Bolt', 'Gear', 'Plate', 'Ring', 'Widget'],
    lambda v: CASE WHEN list_contains(locations, v) THEN 1 ELSE 0 END), '') AS hot FROM located"""
)
def multi_hot(spark, sf):
    labels = A.map_to_groups(A.parse_annotations(F.col("annotation")), PART_GROUPS)
    hot = A.multi_hot(labels, ["Bolt", "Gear", "Plate", "Ring", "Widget"])
    return annotated_parts(spark, sf).select(
        "p_partkey", F.array_join(hot.cast("array<string>"), "").alias("hot")
    )


EXTERNAL_MAP = {"red": "Warm", "hot": "Warm", "blue": "Cool", "cold": "Cool", "ring": "Ring"}


@query(
    """WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ',
    ' | ') || '||' || upper(p_name), '|'), lambda s: trim(s)), lambda s: s <> '') AS tokens FROM part),
    m AS (SELECT p_partkey, list_filter(list_transform(tokens, lambda x: CASE lower(x)
     WHEN 'red' THEN 'Warm' WHEN 'hot' THEN 'Warm' WHEN 'blue' THEN 'Cool' WHEN 'cold' THEN 'Cool'
     WHEN 'ring' THEN 'Ring' END), lambda y: y IS NOT NULL) AS mapped FROM t)
    SELECT p_partkey, array_to_string(list_filter(mapped, lambda v, i:
     list_position(mapped, v) = i), '|') AS labels FROM m"""
)
def map_external_labels(spark, sf):
    text = F.expr("concat(replace(p_name, ' ', ' | '), '||', upper(p_name))")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(A.map_external_labels(text, EXTERNAL_MAP), "|").alias("labels"),
    )


@query(
    """WITH ids AS (SELECT doc_id, concat(lang, '|', CASE WHEN source = 'src3' THEN ''
    ELSE source END, '|', CAST(doc_id AS VARCHAR)) AS id FROM documents)
    SELECT doc_id, unnest(CASE WHEN split_part(id, '|', 2) <> '' THEN [id, split_part(id, '|', 2)]
    ELSE [id] END) AS alias FROM ids"""
)
def record_id_aliases(spark, sf):
    ids = F.expr("concat(lang, '|', if(source = 'src3', '', source), '|', cast(doc_id as string))")
    return table(spark, sf, "documents").select(
        "doc_id", F.explode(A.record_id_aliases(ids)).alias("alias")
    )


@query(
    """WITH ids AS (SELECT CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 3 = 1 THEN '9606'
    ELSE CAST(user_id AS VARCHAR) END AS id FROM events)
    SELECT CASE id WHEN '9606' THEN 'Homo sapiens' ELSE CASE WHEN TRY_CAST(id AS BIGINT) IS NULL
    THEN id ELSE 'organism_' || id END END AS name, count(*) AS n FROM ids GROUP BY 1"""
)
def organism_name(spark, sf):
    ids = F.expr(
        "case when user_id % 3 = 0 then event_type when user_id % 3 = 1 then '9606' "
        "else cast(user_id as string) end"
    )
    return (
        table(spark, sf, "events").groupBy(A.organism_name(ids).alias("name")).agg(count())
    )


@query(
    f"""SELECT doc_id, length(c) AS n, md5(c) AS h FROM (SELECT doc_id, regexp_replace(
    upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{P.RESIDUES}]', '', 'g') AS c
    FROM documents)"""
)
def clean_sequence(spark, sf):
    c = S.clean_sequence(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(c).cast("bigint").alias("n"), F.md5(c).alias("h")
    )


@query(
    f"""WITH {DOCS}, starts AS (SELECT doc_id, sequence, length(sequence) AS n, unnest(range(0,
     CAST(ceil(greatest(0, length(sequence) - 200) / 150.0) AS BIGINT) + 1)) AS i FROM docs),
    cut AS (SELECT doc_id, n, i, CASE WHEN n <= 200 THEN sequence
     ELSE substr(sequence, CAST(i * 150 + 1 AS BIGINT), 200) END AS piece FROM starts)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk,
     length(piece) AS n_letters, md5(piece) AS h FROM cut WHERE n <= 200 OR length(piece) >= 60"""
)
def chunk_sequence(spark, sf):
    chunks = F.posexplode(S.chunk_sequence(F.col("sequence"), 200, 50, 60)).alias("chunk", "piece")
    return docs(spark, sf).select("doc_id", chunks).select(
        "doc_id",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.length("piece").cast("bigint").alias("n_letters"),
        F.md5("piece").alias("h"),
    )


def sized_text(col: str) -> str:
    return f"coalesce(CAST(length(CAST({col} AS VARCHAR)) AS VARCHAR) || ':' || CAST({col} AS VARCHAR), '-')"


DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LANES = " || '-' || ".join(
    f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)"
    for i in range(4)
)


@query(
    f"""SELECT count(*) AS n_rows, {LANES} AS content_hash
    FROM (SELECT sha256({" || '|' || ".join(map(sized_text, DOC_COLUMNS))}) AS h FROM documents)"""
)
def content_fingerprint(spark, sf):
    return K.content_fingerprint(table(spark, sf, "documents"))


# --- labels and profiles ------------------------------------------------------------------------


@query(
    f"WITH {LOCATED} SELECT label, count(*) AS n FROM (SELECT unnest(locations) AS label "
    "FROM located) GROUP BY label"
)
def label_counts(spark, sf):
    return L.label_counts(located_parts(spark, sf))


# A bound that removes some but not all classes at every scale: the mean class size.
@query(
    f"""WITH {LOCATED}, cells AS (SELECT p_partkey, unnest(locations) AS label FROM located),
    freq AS (SELECT label FROM cells GROUP BY label HAVING count(*) >= (SELECT count(*) // 8
     FROM cells))
    SELECT p_partkey, string_agg(label, '|' ORDER BY label) AS locations_str
    FROM cells JOIN freq USING (label) GROUP BY p_partkey"""
)
def filter_rare_labels(spark, sf):
    rows = located_parts(spark, sf)
    bound = rows.agg(F.sum(F.size("locations"))).first()[0] // 8
    return L.filter_rare_labels(rows, bound).select(
        "p_partkey", A.labels_to_string(F.col("locations")).alias("locations_str")
    )


@query(
    f"""WITH {LOCATED}, freq AS (SELECT label, count(*) AS n FROM (SELECT unnest(locations) AS label
    FROM located) GROUP BY label) SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT)
    AS label_idx, n FROM freq"""
)
def discover_labels(spark, sf):
    return L.discover_labels(located_parts(spark, sf)).withColumn(
        "label_idx", F.col("label_idx").cast("bigint")
    )


@query(
    f"""WITH {LOCATED}, freq AS (SELECT label, count(*) AS n FROM (SELECT unnest(locations) AS label
    FROM located) GROUP BY label), w AS (SELECT label, 1.0 / (CAST(n AS DOUBLE) + 0.1) AS w FROM freq)
    SELECT label, round(w / avg(w) OVER (), 6) AS weight FROM w"""
)
def class_weights(spark, sf):
    weights = L.class_weights(L.discover_labels(located_parts(spark, sf)))
    return weights.select("label", F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {RAW}, r AS (SELECT CASE WHEN ord = 7 THEN NULL ELSE accession END AS accession,
    sequence, CASE WHEN organism_id = 'src4' THEN NULL ELSE subcellular_location END AS loc FROM raw)
    SELECT count(*) AS total_rows, count(*) - count(accession) AS null_accession,
     count(*) - count(sequence) AS null_sequence, count(*) - count(loc) AS null_subcellular_location,
     CAST(count_if(regexp_matches(sequence, '[^{P.RESIDUES}]')) AS BIGINT) AS nonstandard_sequences,
     round(avg(length(sequence)), 6) AS sequence_length_mean,
     round(median(length(sequence)), 6) AS sequence_length_median,
     count(DISTINCT accession) AS unique_accessions,
     count(*) - count(DISTINCT accession) - CAST(count(*) > count(accession) AS BIGINT)
     AS duplicate_accessions FROM r"""
)
def profile_raw(spark, sf):
    raw = C.normalize_columns(raw_pages(spark, sf)).select(
        F.when(F.col("ord") != 7, F.col("accession")).alias("accession"),
        "sequence",
        F.when(F.col("organism_id") != "src4", F.col("subcellular_location")).alias(
            "subcellular_location"
        ),
    )
    out = R.profile_raw(raw)
    return out.select(
        *[
            F.round(c, 6).alias(c) if "length" in c else F.col(c).cast("bigint").alias(c)
            for c in out.columns
        ]
    )


@query(
    f"""WITH {LOCATED}, freq AS (SELECT label, count(*) AS n FROM (SELECT unnest(locations) AS label
    FROM located) GROUP BY label)
    SELECT count(*) AS total_rows, CAST(count_if(len(locations) = 0) AS BIGINT) AS unlabelled_rows,
     round(avg(len(locations)), 2) AS avg_labels_per_row,
     round(avg(CAST(len(locations) > 1 AS INT)), 3) AS multi_label_fraction,
     (SELECT count(*) FROM freq) AS num_classes,
     (SELECT CAST(count_if(n < 300) AS BIGINT) FROM freq) AS classes_below_min,
     (SELECT round(max(n) / min(n), 1) FROM freq) AS max_min_class_ratio FROM located"""
)
def profile_processed(spark, sf):
    rows = annotated_parts(spark, sf).withColumn(
        "locations", A.map_to_groups(A.parse_annotations(F.col("annotation")), PART_GROUPS)
    )
    return R.profile_processed(rows, 300)


@query(
    f"""WITH {LOCATED}, p AS (SELECT count_if(len(locations) = 0) AS unlabelled FROM located),
    c AS (SELECT count_if(n < 300) AS small FROM (SELECT count(*) AS n FROM (SELECT
     unnest(locations) AS label FROM located) GROUP BY label))
    SELECT * FROM (SELECT 'unlabelled_rows' AS "check", 'error' AS severity,
     CAST(unlabelled AS DOUBLE) AS value FROM p UNION ALL
     SELECT 'classes_below_min', 'warning', CAST(small AS DOUBLE) FROM c) WHERE value > 0"""
)
def processed_checks(spark, sf):
    return R.processed_checks(profile_processed(spark, sf)).select("check", "severity", "value")


SPLIT_OF_SOURCE = "CASE WHEN source < 'src12' THEN 'train' WHEN source < 'src16' THEN 'val' ELSE 'test' END"


@query(
    f"""WITH s AS (SELECT {SPLIT_OF_SOURCE} AS split, lang FROM documents),
    n AS (SELECT split, count(*) AS size FROM s GROUP BY split),
    c AS (SELECT split, lang AS label, count(*) AS k FROM s GROUP BY split, lang)
    SELECT split, size, label, round(CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY split), 6) AS share
    FROM n JOIN c USING (split)"""
)
def profile_splits(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.expr(SPLIT_OF_SOURCE).alias("split"), F.array("lang").alias("locations")
    )
    return R.profile_splits(rows).withColumn("share", F.round("share", 6))


@query(
    f"""WITH s AS (SELECT DISTINCT md5(text) AS k, {SPLIT_OF_SOURCE} AS split FROM documents)
    SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM s a JOIN s b
    ON a.k = b.k AND a.split < b.split GROUP BY 1, 2"""
)
def split_leakage(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.md5("text").alias("accession"), F.expr(SPLIT_OF_SOURCE).alias("split")
    )
    return R.split_leakage(rows)
