"""Queries of the corpus operators over the test tables, and the same queries as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.llm.decontam import find_spans, hit_digests
from seqtables.llm import reputation
from seqtables.llm.secrets import scan_history, secret_digests
from seqtables.llm.jaccard import jaccard_components
from seqtables.llm.packing import pack_documents
from seqtables.llm.perspectives import rotate_perspectives
from seqtables.llm.quality import THRESHOLD as QUALITY_THRESHOLD
from seqtables.llm.quality import quality_scores
from seqtables.llm import search_catalog
from seqtables.llm.sharding import shard_documents
from seqtables.llm.syncmers import fingerprint_edits
from seqtables.llm.tables import held_out, table
from seqtables.llm.toxicity import THRESHOLD as TOXIC_THRESHOLD
from seqtables.llm.toxicity import toxicity_scores

SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_words(pattern: str) -> str:
    """DuckDB list of the words of ``text``, ASCII letters lower-cased."""
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"




def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = find_spans(docs, table(spark, folder, "benchmark"), "doc_id", "text")
    return hit_digests(found).withColumnRenamed("row_id", "doc_id")


def op1_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    return reputation.judge_urls(table(spark, folder, "pages"), "page_id", "url")


def sql_rules(column: int) -> str:
    """CASE over the rules, the longest first, giving the rule or its verdict."""
    ordered = sorted(reputation.RULES, key=lambda r: -len(r[1] + r[2]))
    lines = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
        f"THEN '{(h + p, v)[column]}'"
        for v, h, p in ordered
    ]
    return f"CASE {' '.join(lines)} END"


def sql_shrink(children: str, parents: str, parent: str) -> str:
    return f"""
    SELECT *, a / (a + b) AS mean FROM (
        SELECT c.*, c.bad + strength * p.mean AS a, c.n - c.bad + strength * (1 - p.mean) AS b
        FROM {children} c JOIN {parents} p USING ({parent}), (
            SELECT 1 / greatest({reputation.LEAST_RHO}, least({reputation.MOST_RHO}, CASE
                WHEN sum((n - 1) * v) FILTER (WHERE n > 0) > 0
                THEN (sum(n * d * d) FILTER (WHERE n > 0) - sum(v) FILTER (WHERE n > 0))
                    / sum((n - 1) * v) FILTER (WHERE n > 0)
                ELSE {reputation.MOST_RHO} END)) - 1 AS strength
            FROM (SELECT c.n, p.mean * (1 - p.mean) AS v,
                    CASE WHEN c.n > 0 THEN c.bad / c.n - p.mean END AS d
                FROM {children} c JOIN {parents} p USING ({parent}))))"""


SQL["op1_host_reputation"] = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
        THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), placed AS (
    SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM cut
), sides AS (
    SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM placed
), ruled AS (
    SELECT *, {sql_rules(0)} AS rule, {sql_rules(1)} AS ruled FROM sides
), hosts AS (
    SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
        CAST(count(*) FILTER (WHERE ruled = 'block') AS DOUBLE) AS bad, count(ruled) AS n
    FROM ruled GROUP BY host
), domains AS (
    SELECT domain, string_split(domain, '.')[-1] AS suffix, sum(bad) AS bad, sum(n) AS n
    FROM hosts GROUP BY domain
), suffixes AS (
    SELECT suffix, 0 AS root, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY suffix
), roots AS (
    SELECT 0 AS root, (sum(bad) + {reputation.START * reputation.WEIGHT})
        / (sum(n) + {reputation.WEIGHT}) AS mean FROM suffixes
), s AS ({sql_shrink("suffixes", "roots", "root")}
), d AS ({sql_shrink("domains", "s", "suffix")}
), h AS ({sql_shrink("hosts", "d", "domain")}
), known AS (
    SELECT host, n, mean, mean - {reputation.Z} * sqrt(mean * (1 - mean) / (a + b + 1)) AS low
    FROM h
)
SELECT page_id, host, path, rule, coalesce(ruled,
        CASE WHEN round(low, 9) > {reputation.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
    CAST(n AS BIGINT) AS host_outcomes, round(mean, 6) AS block_rate, round(low, 6) AS block_bound
FROM ruled JOIN known USING (host)
"""


def op2_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    found = rotate_perspectives(turns, "conv_id", "turn", "role", "text")
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        F.col("dialogue").alias("conv_id"),
        "perspective",
        "part",
        "n_turns",
        "text",
        F.array_join(spans, ",").alias("train_spans"),
    )


SQL["op2_perspectives"] = """
WITH turns AS (
    SELECT conv_id, role, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS pos
    FROM conversations
), people AS (
    SELECT DISTINCT conv_id, role AS perspective FROM turns
    WHERE role IS NOT NULL AND role <> 'system'
), lines AS (
    SELECT t.conv_id, perspective, CAST(pos // 256 AS INTEGER) AS part, pos,
        role IS NOT DISTINCT FROM perspective AS own,
        '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system'
            THEN 'system' ELSE 'user' || coalesce(' name=' || role, '') END || chr(10) AS head,
        content || '<|im_end|>' AS body
    FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
    SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
        PARTITION BY conv_id, perspective, part ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
    FROM lines
)
SELECT conv_id, perspective, part, count(*) AS n_turns,
    string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
    coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ','
        ORDER BY pos) FILTER (WHERE own), '') AS train_spans
FROM placed GROUP BY conv_id, perspective, part
"""


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_components(table(spark, folder, "documents"), "doc_id", "text")
    return found.withColumnRenamed("row_id", "doc_id")


SPACED_WORDS = sql_words(r"[^\x20\x09-\x0D]+")


def sql_links(source: str, width: int, percent: int) -> str:
    """CTEs ``sized`` (doc_id, n) and ``component`` (doc_id, component_id) over ``source``."""
    return f"""
split AS (SELECT doc_id, {SPACED_WORDS} AS w FROM {source}
), shingled AS (
    SELECT doc_id, w, least({width}, len(w)) AS size,
        unnest(range(1, CAST(len(w) - least({width}, len(w)) + 2 AS BIGINT))) AS i
    FROM split WHERE len(w) > 0
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + size - 1], ' ') AS g FROM shingled
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), prefix AS (
    SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r
    FROM sets JOIN sizes USING (doc_id) JOIN (SELECT g, count(*) AS c FROM sets GROUP BY g) USING (g)
), kept AS (SELECT doc_id, g, n FROM prefix WHERE r <= n - ceil({percent} * n / 100.0) + 1
), pairs AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM kept a JOIN kept b
    ON a.g = b.g AND a.doc_id < b.doc_id
    AND {percent} * a.n <= 100 * b.n AND {percent} * b.n <= 100 * a.n
), links AS (
    SELECT a, b FROM (
        SELECT p.a, p.b, na, nb, count(*) AS shared FROM pairs p
        JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b AND x.g = y.g
        GROUP BY ALL
    ) WHERE 100 * shared >= {percent} * (na + nb - shared)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM {source}
    UNION SELECT r.a, s.b FROM reach r JOIN sides s ON s.a = r.b
), component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
), sized AS (
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM split LEFT JOIN sizes USING (doc_id)
)"""


SQL["op3_jaccard_join"] = f"""
WITH RECURSIVE {sql_links("documents", 3, 90)}
SELECT doc_id, n AS n_shingles, component_id FROM sized JOIN component USING (doc_id)
"""


def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = shard_documents(table(spark, folder, "documents"), "doc_id", "text")
    return found.select(
        F.col("row_id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


ALNUM_WORDS = sql_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SQL["op5_decontaminate"] = f"""
WITH items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {ALNUM_WORDS} AS w FROM benchmark
), spots AS (
    SELECT item, w, least(10, len(w)) AS size,
        unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS i
    FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM spots
), docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, {ALNUM_WORDS} AS w FROM documents
), places AS (
    SELECT row_id, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i
    FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), found AS (
    SELECT row_id, item, i, p.size FROM (
        SELECT row_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words FROM places
    ) p JOIN windows v ON v.size = p.size AND v.words = p.words
), hit AS (
    SELECT row_id, count(DISTINCT spot) AS n_hit
    FROM (SELECT row_id, unnest(range(i, i + size)) AS spot FROM found) GROUP BY row_id
), named AS (
    SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row_id, item FROM found) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        F.col("row_id").alias("doc_id"),
        held_out(F.col("row_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learn = ~held_out(F.col("row_id"))
    return judged(toxicity_scores(docs, labels, "doc_id", "text", "toxic", learn), TOXIC_THRESHOLD)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_pack(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pack_documents(docs, "doc_id", "text", tokenizer_path()).withColumnRenamed("row_id", "doc_id")


def op8_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprint_edits(table(spark, folder, "documents"), "doc_id", "text")
    return found.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("fp_text").alias("fingerprint"),
        F.col("fp_edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learn = ~held_out(F.col("row_id"))
    return judged(quality_scores(docs, labels, "doc_id", "text", "quality", learn), QUALITY_THRESHOLD)


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(scan_history(table(spark, folder, "documents"), "doc_id", "text"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = (
    op1_host_reputation,
    op2_perspectives,
    op3_jaccard_join,
    op4_shards,
    op5_decontaminate,
    op6_toxicity,
    op7_pack,
    op8_fingerprint,
    op9_quality,
    op10_secret_scan,
    *search_catalog.QUERIES,
    pipeline,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL | search_catalog.SQL
