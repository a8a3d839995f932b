"""Queries of the operators for search, runs and vectors over the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqtables.llm.runs import periodic_runs, planted_order
from seqtables.llm.search import ranked_search
from seqtables.llm.tables import table
from seqtables.llm.vectors import near_vectors

SQL: dict[str, str] = {}


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = ranked_search(docs, items, "doc_id", "text")
    return found.withColumnsRenamed({"item": "item_id", "row_id": "doc_id"})


SQL_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL["op11_ranked_search"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, {SQL_TERMS} AS w FROM documents
), filled AS (
    SELECT row_id, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0
), totals AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM filled
), counts AS (
    SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM filled)
    GROUP BY row_id, term
), weighted AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM counts, totals GROUP BY term, docs
), items AS (
    SELECT row_number() OVER () AS item, item_id, {SQL_TERMS} AS w FROM benchmark
), asked AS (
    SELECT DISTINCT item, term FROM (SELECT item, unnest(w) AS term FROM items)
), scores AS (
    SELECT item, row_id, CAST(sum(weight * ((1000000000 * tf) //
        (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN weighted USING (term) JOIN counts USING (term) JOIN filled USING (row_id), totals
    GROUP BY item, row_id
), ranked AS (
    SELECT item, doc_id, score, row_number() OVER (
        PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scores JOIN filled USING (row_id) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM ranked JOIN items USING (item) WHERE rank <= 10
"""


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = periodic_runs(docs, "doc_id", "text", edit=planted_order)
    return found.drop("runs").withColumnRenamed("row_id", "doc_id")


# crc32 of the decimal digits, bit by bit; the polynomial is the standard's.
SQL_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
            lambda y, i: xor(y >> 1, (y & 1) * 3988292384))))"""

SQL["op12_periodic_runs"] = rf"""
WITH split AS (
    SELECT row_number() OVER () AS row_id, doc_id, {SQL_CRC32} AS h,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sized AS (
    SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM split
), marked AS (
    SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM sized
), spots AS (
    SELECT row_id, n, a, w, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM marked
), words AS (
    SELECT row_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM spots
), same AS (
    SELECT x.row_id, x.i, y.i - x.i AS p FROM words x JOIN words y
    ON x.row_id = y.row_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), placed AS (
    SELECT *, i - row_number() OVER (PARTITION BY row_id, p ORDER BY i) AS island FROM same
), stretches AS (
    SELECT row_id, p, min(i) AS s, min(i) + count(*) + p AS e FROM placed
    GROUP BY row_id, p, island HAVING count(*) + p >= greatest(12, 2 * p)
), runs AS (
    SELECT row_id, s, e, e - s AS size, min(p) AS p FROM stretches GROUP BY row_id, s, e
), listed AS (
    SELECT row_id, count(*) AS n_runs,
        string_agg(s || ',' || size || ',' || p || chr(10), '' ORDER BY s, p) AS lines
    FROM runs GROUP BY row_id
), longest AS (
    SELECT * FROM runs
    QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY size DESC, s, p) = 1
), dropped AS (
    SELECT DISTINCT row_id, unnest(range(s + p, e)) AS i FROM runs
), kept AS (
    SELECT row_id, string_agg(word, ' ' ORDER BY i) AS rest
    FROM words ANTI JOIN dropped USING (row_id, i) GROUP BY row_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, size AS length, l.p AS period,
    1000 * size // l.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(coalesce(rest, '')) AS collapsed_sha256
FROM split LEFT JOIN listed USING (row_id) LEFT JOIN longest l USING (row_id)
LEFT JOIN kept USING (row_id)
"""


def op13_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return found.withColumnRenamed("row_id", "vec_id")


SQL["op13_embedding_near_dedup"] = """
WITH RECURSIVE numbered AS (
    SELECT row_number() OVER () AS row_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
    SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM numbered
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.row_id AS a, b.row_id AS b, a.vec_id AS va, b.vec_id AS vb
    FROM sound a JOIN sound b ON a.row_id <> b.row_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reach AS (
    SELECT row_id AS a, row_id AS b, vec_id AS vb FROM numbered
    UNION SELECT r.a, l.b, l.vb FROM reach r JOIN links l ON l.a = r.b
), component AS (SELECT a AS row_id, min(vb) AS component_id FROM reach GROUP BY a
), counted AS (SELECT a AS row_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id,
    coalesce(vec_id = component_id, false) AS kept
FROM numbered JOIN component USING (row_id) LEFT JOIN counted USING (row_id)
"""


QUERIES = (op11_ranked_search, op12_periodic_runs, op13_embedding_near_dedup)
