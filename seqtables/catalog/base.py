"""Inputs the catalog queries share, and the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions import kmers
from seqtables.functions.scores import binarize, probabilities
from seqtables.operators.clean import sequence_from_text
from seqtables.sources.tables import spread_scan


def registry():
    """Two dicts, functions and SQL by name, and the decorator that fills them."""
    functions: dict = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(fn):
            functions[fn.__name__] = fn
            if sql is not None:
                sqls[fn.__name__] = sql
            return fn

        return register

    return functions, sqls, query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def count(col: str = "n") -> Column:
    return F.count(F.lit(1)).alias(col)


def r6(col: Column | str) -> Column:
    """Doubles are compared at six decimals."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def joined(col: str | Column) -> Column:
    """Array of rounded doubles as text with six decimals."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0)), ",")


# --- sequences from documents -----------------------------------------------------------------

SEQ = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOZ', 'NLKQ')"
DOCS = f"docs AS (SELECT doc_id, lang, source, {SEQ} AS sequence FROM documents)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return spread_scan(rows).select(
        "doc_id", "lang", "source", sequence_from_text(F.col("text")).alias("sequence")
    )


def hash_sql(code: str) -> str:
    """The k-mer hash as SQL."""
    a = f"(({code}) % {kmers.PRIME_A} * {kmers.MULTIPLIER_A} + 1) % {kmers.PRIME_A}"
    b = f"(({code}) % {kmers.PRIME_B} * {kmers.MULTIPLIER_B} + 1) % {kmers.PRIME_B}"
    return f"(({a}) * {2**31} + ({b}))"


# --- annotations from parts -------------------------------------------------------------------

PART_GROUPS = {
    "Economy": ("economy", "standard"),
    "Small goods": ("small", "medium"),
    "Large goods": ("large",),
    "Ring": ("ring",),
    "Bolt": ("bolt", "rod"),
    "Gear": ("gear",),
    "Widget": ("widget", "gizmo"),
    "Plate": ("plate",),
}

ANNOTATION = """concat('SUBCELLULAR LOCATION: ', p_type, ' {ECO:0000269|', p_brand,
 '}; Multi-pass membrane protein. ', p_name, ' {ECO:', cast(p_size as varchar(9)),
 '}. SUBCELLULAR LOCATION: ', p_name, ';; Note=Also in ', p_type, '. ', p_name)"""


def annotated_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        F.expr(ANNOTATION).alias("annotation"),
    )


TOPOLOGY_RE = "|".join(P.TOPOLOGY_TERMS)


def parse_sql(x: str) -> str:
    return (
        "list_filter(list_transform(flatten(list_transform(string_split(split_part(replace("
        f"{x}, 'SUBCELLULAR LOCATION: ', ''), 'Note=', 1), '.'), lambda s: string_split(s, ';'))), "
        r"lambda p: regexp_replace(regexp_replace(p, '\s*\{[^}]*\}', '', 'g'), '^\s+|\s+$', '', 'g')), "
        f"lambda q: q <> '' AND NOT regexp_matches(lower(q), '{TOPOLOGY_RE}'))"
    )


def groups_sql(x: str, groups=None) -> str:
    groups = PART_GROUPS if groups is None else groups
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(g), '{k}')" for k in ks) + f" THEN '{name}'"
        for name, ks in groups.items()
    )
    return (
        f"list_sort(list_distinct(list_filter(list_transform({x}, lambda g: CASE {cases} END), "
        "lambda h: h IS NOT NULL)))"
    )


LOCATED = (
    f"parts AS (SELECT p_partkey, {ANNOTATION} AS annotation FROM part), "
    f"parsed AS (SELECT p_partkey, annotation, {parse_sql('annotation')} AS raw FROM parts), "
    f"located AS (SELECT p_partkey, annotation, raw, {groups_sql('raw')} AS locations FROM parsed)"
)


# --- raw records: a document's letters with a part's annotation -------------------------------

RAW = f"""raw AS (SELECT concat('P', cast((doc_id * 9) // 10 AS varchar)) AS accession,
 {SEQ} AS sequence, {ANNOTATION} AS subcellular_location, doc_id AS ord, source AS organism_id
 FROM documents JOIN part ON p_partkey = doc_id)"""


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = spread_scan(table(spark, sf, "documents").select("doc_id", "source", "text"))
    p = table(spark, sf, "part")
    return d.join(p, d["doc_id"] == p["p_partkey"]).select(
        F.expr("concat('P', cast((doc_id * 9) div 10 as string))").alias("Entry"),
        sequence_from_text(F.col("text")).alias("Sequence"),
        F.expr(ANNOTATION).alias("Subcellular location [CC]"),
        F.col("source").alias("Organism (ID)"),
        F.col("doc_id").alias("ord"),
    )


PROCESSED_LONG = f"""{RAW},
 firsts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY accession ORDER BY ord) = 1),
 mapped AS (SELECT accession, sequence, organism_id, {groups_sql(parse_sql('subcellular_location'))}
  AS locations FROM firsts WHERE sequence <> '' AND subcellular_location <> ''),
 usable AS (SELECT * FROM mapped WHERE len(locations) > 0 AND length(sequence) BETWEEN 30 AND 2048
  AND regexp_matches(upper(sequence), '^[ACDEFGHIKLMNPQRSTVWYXU]+$')),
 freq AS (SELECT label, count(*) AS n FROM (SELECT unnest(locations) AS label FROM usable)
  GROUP BY label HAVING count(*) >= 50),
 cells AS (SELECT accession, organism_id, unnest(locations) AS label FROM usable),
 kept AS (SELECT cells.* FROM cells JOIN freq USING (label))"""


# --- scored rows from embeddings --------------------------------------------------------------

N_CLASSES = 10
CLASS_NAMES = [f"class_{i}" for i in range(N_CLASSES)]
ORGANISMS = (9606, 10090, 559292, 10116, 7227, 6239, 4932)

SCORED = f"""scored AS (SELECT vec_id AS id, {list(ORGANISMS)}[(vec_id % 7) + 1] AS organism_id,
 logits, y, probs, list_transform(probs, lambda p: CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS preds
 FROM (SELECT *, list_transform(logits, lambda z: 1.0 / (1.0 + exp(-z))) AS probs FROM (
  SELECT vec_id,
   list_transform(range(1, 11), lambda c: CAST(embedding[c] AS DOUBLE) * 20.0) AS logits,
   list_transform(range(0, 10), lambda c: CASE WHEN label = c
    OR CAST(embedding[c + 11] AS DOUBLE) > 0.2 THEN 1 ELSE 0 END) AS y
  FROM embeddings)))"""
CELLS = f"""{SCORED},
 cells AS (SELECT id, organism_id, c AS label_idx, logits[c + 1] AS z, y[c + 1] AS y,
  probs[c + 1] AS p, preds[c + 1] AS pred, preds = y AS exact
  FROM scored, (SELECT unnest(range(0, 10)) AS c))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    classes = F.sequence(F.lit(0), F.lit(N_CLASSES - 1))

    def value(i: Column) -> Column:
        return F.get(F.col("embedding"), i).cast("double")

    rows = e.select(
        F.col("vec_id").alias("id"),
        F.get(F.array(*[F.lit(o) for o in ORGANISMS]), (F.col("vec_id") % 7).cast("int")).alias(
            "organism_id"
        ),
        F.transform(classes, lambda c: value(c) * 20.0).alias("logits"),
        F.transform(
            classes, lambda c: ((F.col("label") == c) | (value(c + 10) > 0.2)).cast("int")
        ).alias("y"),
    )
    return rows.withColumn("probs", probabilities(F.col("logits"))).withColumn(
        "preds", binarize(F.col("probs"))
    )
