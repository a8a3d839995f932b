"""Catalog: splits, clusters, batches, chunks and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.catalog.base import (
    DOCS,
    PART_GROUPS,
    PROCESSED_LONG,
    docs,
    hash_sql,
    r6,
    raw_pages,
    registry,
    table,
)
from seqtables.functions.keys import stable_key
from seqtables.functions.sequences import chunk_sequence
from seqtables.operators import batching as B
from seqtables.operators import joins as J
from seqtables.operators import pooling as T
from seqtables.operators import reference as R
from seqtables.operators import similarity as M
from seqtables.operators import splits as W
from seqtables.plans.prepare import prepare, prepare_splits
from seqtables.session import stored_table

Q, SQL, query = registry()


def key_sql(seed, col: str) -> str:
    return f"(md5('{seed}|' || CAST({col} AS VARCHAR)) || '|' || CAST({col} AS VARCHAR))"


def clustered(spark, sf):
    """Documents with a cluster from the leading digits of their text hash."""
    return table(spark, sf, "documents").select(
        "doc_id", F.left(F.md5("text"), F.lit(2)).alias("cluster_id"), "lang", "source"
    )


@query(
    f"""WITH d AS (SELECT doc_id, substr(md5(text), 1, 2) AS cluster_id FROM documents),
    c AS (SELECT cluster_id, row_number() OVER (ORDER BY {key_sql(42, 'cluster_id')}) AS k,
     count(*) OVER () AS n FROM (SELECT DISTINCT cluster_id FROM d))
    SELECT doc_id, cluster_id, CASE WHEN k <= greatest(1, floor(n * 0.15)) THEN 'test'
     WHEN k <= greatest(1, floor(n * 0.15)) + greatest(1, floor(n * 0.15)) THEN 'val'
     ELSE 'train' END AS split FROM d JOIN c USING (cluster_id)"""
)
def cluster_split(spark, sf):
    return W.cluster_split(clustered(spark, sf)).select("doc_id", "cluster_id", "split")


def stratified_sql(source: str, key: str, stratum: str) -> str:
    """CTEs up to ``s``: the columns of ``source`` with ``split``; totals by largest remainder."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY
  {key_sql(42, key)}) AS k FROM {source}),
 g AS (SELECT {stratum}, count(*)::HUGEINT AS n, sum(count(*)) OVER () AS total
  FROM {source} GROUP BY {stratum}),
 a AS (SELECT *, round(total * 0.15::DOUBLE)::HUGEINT AS nt FROM g),
 b AS (SELECT *, n * nt // total + (row_number() OVER (ORDER BY n * nt % total DESC,
  {key_sql("42|test", stratum)}) <= nt - sum(n * nt // total) OVER ())::INT AS t FROM a),
 c AS (SELECT *, n - t AS m, total - nt AS rest,
  round((total - nt) * (0.15::DOUBLE / 0.85::DOUBLE))::HUGEINT AS nv FROM b),
 e AS (SELECT {stratum}, t, t + m * nv // rest + (row_number() OVER (ORDER BY m * nv % rest DESC,
  {key_sql("42|val", stratum)}) <= nv - sum(m * nv // rest) OVER ())::INT AS tv FROM c),
 s AS (SELECT r.*, CASE WHEN k <= t THEN 'test' WHEN k <= tv THEN 'val' ELSE 'train' END AS split
  FROM r JOIN e USING ({stratum}))"""


STRATIFIED = stratified_sql("documents", "doc_id", "lang")


@query(f"WITH {STRATIFIED} SELECT doc_id, lang, split FROM s")
def stratified_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return W.stratified_split(d, "lang", "doc_id")


@query(f"WITH {stratified_sql('orders', 'o_orderkey', 'o_custkey')} SELECT o_orderkey, split FROM s")
def small_strata_split(spark, sf):
    """Thousands of strata of a few rows each."""
    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"))
    return W.stratified_split(d, "c", "o_orderkey").select("o_orderkey", "split")


@query(
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {key_sql(7, 'doc_id')}) AS k,
     count(*) OVER () AS n FROM documents), q AS (SELECT *, round(n * 0.2::DOUBLE) AS t FROM r)
    SELECT doc_id, CASE WHEN k <= t THEN 'test' WHEN k <= t + round((n - t) * (0.1::DOUBLE / 0.8::DOUBLE))
     THEN 'val' ELSE 'train' END AS split FROM q"""
)
def random_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return W.random_split(d, "doc_id", 0.2, 0.1, 7)


@query(
    """WITH c AS (SELECT substr(md5(text), 1, 2) AS cluster_id, doc_id FROM documents
     WHERE lang <> 'es'), s AS (SELECT DISTINCT cluster_id, CASE WHEN cluster_id < '40' THEN 'test'
     WHEN cluster_id < '80' THEN 'val' ELSE 'train' END AS split FROM c)
    SELECT split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
     JOIN c USING (doc_id) JOIN s USING (cluster_id) GROUP BY split"""
)
def attach_clusters(spark, sf):
    d = table(spark, sf, "documents")
    c = clustered(spark, sf).filter("lang <> 'es'").select("doc_id", "cluster_id")
    by_cluster = c.select("cluster_id").distinct().withColumn(
        "split",
        F.when(F.col("cluster_id") < "40", "test")
        .when(F.col("cluster_id") < "80", "val")
        .otherwise("train"),
    )
    rows = J.attach_clusters(d.select("doc_id", "n_chars"), c, "doc_id")
    out = J.assign_split(rows, by_cluster)
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query(
    """WITH p AS (SELECT o_orderpriority || '-' || o_orderstatus AS rep, o_orderkey FROM orders),
    f AS (SELECT rep, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS cluster_id FROM p GROUP BY rep)
    SELECT CAST(o_orderkey AS VARCHAR) AS accession, cluster_id FROM p JOIN f USING (rep)"""
)
def cluster_numbers(spark, sf):
    pairs = table(spark, sf, "orders").select(
        F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("representative"),
        F.col("o_orderkey").cast("string").alias("member"),
        F.col("o_orderkey").alias("ordinal"),
    )
    return M.read_cluster_numbers(pairs, "ordinal")


K, SKETCH, IDENTITY = 9, 20, 0.3


def similar_sql(source: str, key: str, k: int) -> str:
    """CTE ``clustered (key, cluster_id)`` of ``(key, sequence)`` rows, from a comparison of all pairs."""
    code = " + ".join(f"CAST(ascii(s[i + {j}]) - 64 AS BIGINT) * {27 ** (k - 1 - j)}" for j in range(k))
    return f"""reps AS (SELECT sequence, min({key}) AS id, length(sequence) AS len
     FROM {source} GROUP BY sequence),
    letters AS (SELECT id, len, string_split(sequence, '') AS s FROM reps WHERE len >= {k}),
    grams AS (SELECT DISTINCT id, len, unnest(list_transform(range(1, len - {k} + 2),
     lambda i: CAST({code} AS BIGINT))) AS g FROM letters),
    sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
    common AS (SELECT a.id AS u, b.id AS v, count(*) AS c FROM grams a JOIN grams b
     ON a.g = b.g AND a.id < b.id AND least(a.len, b.len) >= greatest(a.len, b.len) * {P.COVERAGE}
     GROUP BY a.id, b.id),
    links AS (SELECT u, v FROM common JOIN sizes x ON x.id = u JOIN sizes y ON y.id = v
     WHERE c / (x.n + y.n - c)::DOUBLE >= {IDENTITY}),
    edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    walk AS (SELECT id AS node, id AS reach FROM reps UNION
     SELECT node, v FROM walk JOIN edges ON u = reach),
    roots AS (SELECT node, min(reach) AS root FROM walk GROUP BY node),
    clustered AS (SELECT {key}, root AS cluster_id FROM {source} JOIN reps USING (sequence)
     JOIN roots ON node = id)"""


@query(
    f"""WITH RECURSIVE {PROCESSED_LONG}, source AS (SELECT accession, sequence FROM usable
     WHERE accession IN (SELECT accession FROM kept)), {similar_sql('source', 'accession', 6)},
    c AS (SELECT cluster_id, row_number() OVER (ORDER BY {key_sql(42, 'cluster_id')}) AS k,
     count(*) OVER () AS n FROM (SELECT DISTINCT cluster_id FROM clustered))
    SELECT accession, CASE WHEN k <= greatest(1, floor(n * 0.15)) THEN 'test'
     WHEN k <= greatest(1, floor(n * 0.15)) + greatest(1, floor(n * 0.15)) THEN 'val'
     ELSE 'train' END AS split FROM clustered JOIN c USING (cluster_id)"""
)
def homology_split(spark, sf):
    """Raw pages cleaned, clustered by similarity and split by whole clusters, all by default."""
    processed = prepare(raw_pages(spark, sf), ["ord"], PART_GROUPS, store=True)
    return prepare_splits(processed).select("accession", "split")


@query(
    f"""WITH RECURSIVE {DOCS}, {similar_sql('docs', 'doc_id', K)}
    SELECT doc_id, cluster_id FROM clustered"""
)
def cluster_similar(spark, sf):
    """Clusters of similar texts; the SQL compares all pairs, so equal rows show a recall of one."""
    return M.cluster_similar(
        docs(spark, sf), "doc_id", "sequence", k=K, sketch=SKETCH, identity=IDENTITY
    )


def normal_sql(key: str) -> str:
    def u(slot: int) -> str:
        return f"((CAST('0x' || substr({key}, {1 + 8 * slot}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

    return f"(sqrt(-2.0 * ln({u(0)})) * cos(2.0 * pi() * {u(1)}))"


BUCKETED = f"""s AS (SELECT doc_id, n_chars, round(n_chars + {normal_sql("md5('42|0|' || doc_id)")}
  * (SELECT greatest(1.0, (max(n_chars) - min(n_chars)) * 0.05::DOUBLE) FROM documents), 6) AS k
  FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY k, doc_id) - 1 AS rank FROM s)"""


@query(
    f"""WITH {BUCKETED}, b AS (SELECT doc_id, n_chars, rank, rank // 8 AS batch_id FROM r),
    o AS (SELECT batch_id, row_number() OVER (ORDER BY {key_sql('42|0|batch', 'batch_id')}) - 1
     AS batch_order FROM (SELECT DISTINCT batch_id FROM b))
    SELECT doc_id, n_chars, rank, batch_id, CAST(0 AS BIGINT) AS replica, batch_order
    FROM b JOIN o USING (batch_id)"""
)
def length_bucket_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return B.length_bucket_batches(d, "doc_id", "n_chars", 8)


@query(
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank,
     count(*) OVER () AS n FROM documents)
    SELECT doc_id, n_chars, rank, rank // 14 AS batch_id, (rank % 14) // 7 AS replica,
     rank // 14 AS batch_order FROM r WHERE rank < n // 14 * 14"""
)
def replica_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    out = B.length_bucket_batches(d, "doc_id", "n_chars", 7, replicas=2, shuffle=False)
    return out.select("doc_id", "n_chars", "rank", "batch_id", "replica", "batch_order")


@query(
    f"""WITH {BUCKETED} SELECT rank // 8 AS batch_id, count(*) AS n_rows,
    CAST(max(n_chars) * count(*) - sum(n_chars) AS BIGINT) AS padding FROM r GROUP BY 1"""
)
def padding_waste(spark, sf):
    return B.padding_waste(length_bucket_batches(spark, sf), "n_chars")


def labelled(spark, sf):
    """Rows with three classes: good, toxic (rare), and neither."""
    return table(spark, sf, "labels").select(
        "doc_id",
        F.array(
            F.col("quality"), F.col("toxic"), ((F.col("quality") == 0) & (F.col("toxic") == 0)).cast("int")
        ).alias("y"),
    )


def whole_sql(key: str, n: str) -> str:
    return f"(CAST('0x' || substr({key}, 1, 15) AS BIGINT) % {n})"


def pick_sql(c: int) -> str:
    n = f"(SELECT count(*) FROM pos WHERE c = {c})"
    draw = whole_sql(f"md5('42|0|pick|{c}|' || CAST(b AS VARCHAR))", f"greatest(1, {n})")
    return (
        f"SELECT b, {c} AS c, row_idx FROM batches JOIN pos ON pos.c = {c} AND pos_idx = {draw} "
        f"WHERE {n} < (SELECT count(*) FROM labels) / 3.0 * 0.5"
    )


def permuted_sql(x: str) -> str:
    """One pass of the keyed permutation of ``ka * kb`` cells for batch ``b``."""
    left, right = f"({x} % ka)", f"({x} // ka)"
    for i in range(4):
        other, cells = (right, "ka") if i % 2 == 0 else (left, "kb")
        moved = whole_sql(f"md5('42|0|fill|' || b || '|{i}|' || {other})", cells)
        if i % 2 == 0:
            left = f"(({left} + {moved}) % ka)"
        else:
            right = f"(({right} + {moved}) % kb)"
    return f"({left} + ka * {right})"


@query(
    f"""WITH idx AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY
     {key_sql('42|0', 'doc_id')}) - 1 AS row_idx FROM labels), n AS (SELECT count(*) AS n FROM idx),
    batches AS (SELECT unnest(range(0, (SELECT n // 16 FROM n))) AS b),
    pos AS (SELECT row_idx, 1 AS c, row_number() OVER (ORDER BY row_idx) - 1 AS pos_idx FROM idx
     WHERE toxic = 1 UNION ALL SELECT row_idx, 2, row_number() OVER (ORDER BY row_idx) - 1 FROM idx
     WHERE quality = 0 AND toxic = 0 UNION ALL SELECT row_idx, 0, row_number() OVER
     (ORDER BY row_idx) - 1 FROM idx WHERE quality = 1),
    drawn AS ({pick_sql(0)} UNION ALL {pick_sql(1)} UNION ALL {pick_sql(2)}),
    picks AS (SELECT b, row_idx, min(c) AS c FROM drawn GROUP BY b, row_idx),
    ordered AS (SELECT b, row_idx, row_number() OVER (PARTITION BY b ORDER BY c) - 1 AS slot FROM picks),
    np AS (SELECT b, count(row_idx) AS k FROM batches LEFT JOIN ordered USING (b) GROUP BY b),
    shape AS (SELECT n, ka, CAST(ceil(n / ka) AS BIGINT) AS kb FROM (SELECT n,
     CAST(ceil(sqrt(n)) AS BIGINT) AS ka FROM n)),
    drawn_places AS (SELECT b, k, n, ka, kb, i, {permuted_sql('i')} AS x FROM np, shape,
     (SELECT unnest(range(0, 19)) AS i) WHERE i < n),
    run AS (SELECT b, k, i, list_reduce(list_prepend(x, range(0, least(64, ka * kb - n))),
     lambda x, j: CASE WHEN x < n THEN x ELSE {permuted_sql('x')} END) AS row_idx FROM drawn_places),
    free AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY i) AS f FROM run
     WHERE NOT EXISTS (SELECT 1 FROM ordered o WHERE o.b = run.b AND o.row_idx = run.row_idx)),
    filled AS (SELECT b, slot, row_idx FROM ordered UNION ALL
     SELECT b, k + f - 1, row_idx FROM free WHERE f <= 16 - k)
    SELECT b AS batch_id, CAST(slot AS BIGINT) AS slot, doc_id FROM filled JOIN idx USING (row_idx)"""
)
def balanced_batches(spark, sf):
    out = B.balanced_batches(labelled(spark, sf), "doc_id", "y", 16)
    return out.select("batch_id", F.col("slot").cast("bigint").alias("slot"), "doc_id")


@query(
    """WITH w AS (SELECT o_orderkey, o_custkey, list_transform(string_split(o_orderpriority, ''),
     lambda c: ascii(c)) AS ids FROM orders),
    m AS (SELECT *, max(len(ids)) OVER (PARTITION BY o_custkey) AS width FROM w)
    SELECT o_orderkey, array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)),
     lambda x: 1)), ' ') AS ids, repeat('1', len(ids)) || repeat('0', width - len(ids)) AS mask FROM m"""
)
def pad_batches(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.transform(F.split("o_orderpriority", ""), lambda c: F.ascii(c)).alias("ids"),
    )
    out = B.pad_batches(rows, "o_custkey", "ids")
    return out.select(
        "o_orderkey",
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
        F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"),
    )


# Chunk scores of a document: three simple letter shares per chunk.
CHUNKS = f"""{DOCS}, starts AS (SELECT doc_id, sequence, length(sequence) AS n, unnest(range(0,
  CAST(ceil(greatest(0, length(sequence) - 200) / 150.0) AS BIGINT) + 1)) AS i FROM docs),
 cut AS (SELECT doc_id, n, CASE WHEN n <= 200 THEN sequence
  ELSE substr(sequence, CAST(i * 150 + 1 AS BIGINT), 200) END AS s FROM starts),
 chunks AS (SELECT doc_id, length(s) AS w, CAST(length(s) - length(replace(s, 'E', '')) AS DOUBLE)
  / length(s) AS z0, CAST(length(s) - length(replace(s, 'N', '')) AS DOUBLE) / length(s) AS z1
  FROM cut WHERE n <= 200 OR length(s) >= 50)"""


def chunk_scores(spark, sf):
    rows = docs(spark, sf).select(
        "doc_id", F.explode(chunk_sequence(F.col("sequence"), 200, 50)).alias("s")
    )

    def share(letter: str):
        found = F.length("s") - F.length(F.replace(F.col("s"), F.lit(letter), F.lit("")))
        return F.try_divide(found, F.length("s"))

    # A document without letters is one empty chunk: it has no shares, whatever its weight.
    weight = F.greatest(F.length("s"), F.lit(1))
    return rows.select("doc_id", weight.alias("w"), F.array(share("E"), share("N")).alias("logits"))


@query(
    f"""WITH {CHUNKS} SELECT doc_id, round(avg(z0), 6) AS mean_0, round(avg(z1), 6) AS mean_1,
    round(max(z0), 6) AS max_0, round(max(z1), 6) AS max_1,
    round(sum(w * z0) / sum(w), 6) AS weighted_0, round(sum(w * z1) / sum(w), 6) AS weighted_1
    FROM chunks GROUP BY doc_id"""
)
def aggregate_chunks(spark, sf):
    # The texts are read once; scans for each strategy kept a broadcast waiting beyond its time limit.
    chunks = stored_table(chunk_scores(spark, sf), "chunk-scores")
    out = None
    for strategy in ("mean", "max", "weighted"):
        part = T.aggregate_chunks(chunks, 2, strategy, "doc_id", weight="w").select(
            "doc_id", *[r6(F.col("logits")[i]).alias(f"{strategy}_{i}") for i in range(2)]
        )
        out = part if out is None else out.join(part, "doc_id")
    return out


def tokens(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 10").alias("id"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        (F.col("label") != 3).cast("int").alias("mask"),
        F.col("embedding").alias("vec"),
    )


TOKENS = """tokens AS (SELECT vec_id // 10 AS id, vec_id % 10 AS pos, CASE WHEN label <> 3 THEN 1
  ELSE 0 END AS mask, embedding AS vec FROM embeddings),
 dims AS (SELECT id, pos, mask, d, CAST(vec[d + 1] AS DOUBLE) AS v FROM tokens,
  (SELECT unnest(range(0, 64)) AS d))"""


def pooled(df):
    return df.select("id", F.posexplode("pooled").alias("d", "value")).select(
        "id", F.col("d").cast("bigint").alias("d"), (r6("value") + 0.0).alias("value")
    )


@query(
    f"""WITH {TOKENS} SELECT id, d, round(sum(v * mask) / greatest(sum(mask), 1), 6) + 0.0 AS value
    FROM dims GROUP BY id, d"""
)
def pool_mean(spark, sf):
    return pooled(T.pool_tokens(tokens(spark, sf), 64, "mean"))


@query(
    f"""WITH {TOKENS} SELECT id, d, round(max(CASE WHEN pos = 0 THEN v END), 6) + 0.0 AS value
    FROM dims GROUP BY id, d UNION ALL
    SELECT id, d + 64, round(sum(v * mask) / greatest(sum(mask), 1), 6) + 0.0 FROM dims GROUP BY id, d"""
)
def pool_mean_cls(spark, sf):
    return pooled(T.pool_tokens(tokens(spark, sf), 64, "mean_cls"))


@query(f"WITH {TOKENS} SELECT id, d, round(v, 6) + 0.0 AS value FROM dims WHERE pos = 0")
def pool_cls(spark, sf):
    return pooled(T.pool_tokens(tokens(spark, sf), 64, "cls"))


ATTENTION = [((i * 7) % 11 - 5) / 2.0 for i in range(64)]


@query(
    f"""WITH {TOKENS}, s AS (SELECT id, pos, any_value(mask) AS mask, sum(v
     * CAST({ATTENTION}[d + 1] AS DOUBLE)) + 0.25 AS s FROM dims GROUP BY id, pos),
    w AS (SELECT id, pos, CASE WHEN max(mask) OVER (PARTITION BY id) = 0 THEN 1.0 WHEN mask = 1
     THEN exp(s) ELSE 0.0 END AS w FROM s)
    SELECT id, d, round(sum(v * w) / sum(w), 6) + 0.0 AS value FROM dims JOIN w USING (id, pos)
    GROUP BY id, d"""
)
def attention_pool(spark, sf):
    return pooled(T.attention_pool(tokens(spark, sf), ATTENTION, 0.25))


# External labels: documents are the sequences, parts name them by an alias.
WORD_MAP = {"red": "Warm", "hot": "Warm", "blue": "Cool", "cold": "Cool", "ring": "Ring"}


def reference_inputs(spark, sf):
    sequences = table(spark, sf, "documents").select(
        F.concat_ws("|", "lang", F.concat(F.lit("P"), F.expr("doc_id div 2")), "source").alias("id"),
        F.md5("text").alias("sequence"),
        F.col("doc_id").alias("ord"),
    )
    labels = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(" | ")).alias("raw_locations"),
    )
    return labels, R.alias_table(sequences, "id", "sequence", "ord")


MAPPED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORD_MAP.items())
REFERENCE = f"""seqs AS (SELECT lang || '|P' || (doc_id // 2) || '|' || source AS full_id,
  'P' || (doc_id // 2) AS alias, md5(text) AS sequence, doc_id FROM documents),
 firsts AS (SELECT * FROM seqs QUALIFY row_number() OVER (PARTITION BY alias ORDER BY doc_id) = 1),
 labs AS (SELECT 'P' || p_partkey AS id, replace(p_name, ' ', ' | ') AS raw_locations,
  string_split(p_name, ' ') AS words FROM part),
 looked AS (SELECT id, full_id, sequence, raw_locations, words, list_filter(list_transform(words,
  lambda w: CASE w {MAPPED} END), lambda m: m IS NOT NULL) AS mapped
  FROM labs LEFT JOIN firsts ON alias = id)"""


@query(
    f"""WITH {REFERENCE} SELECT full_id AS accession, sequence, array_to_string(list_filter(mapped,
    lambda v, i: list_position(mapped, v) = i), '|') AS locations_str, raw_locations FROM looked
    WHERE full_id IS NOT NULL AND len(mapped) > 0"""
)
def join_reference(spark, sf):
    return R.join_reference(*reference_inputs(spark, sf), WORD_MAP).drop("locations")


@query(
    f"""WITH {REFERENCE} SELECT count(*) AS n_source_rows,
     CAST(count_if(full_id IS NULL) AS BIGINT) AS n_skipped_missing_sequence,
     CAST(count_if(full_id IS NOT NULL AND len(mapped) = 0) AS BIGINT) AS n_skipped_unmapped_labels
     FROM looked"""
)
def reference_skips(spark, sf):
    return R.reference_skips(*reference_inputs(spark, sf), WORD_MAP)


@query(
    f"""WITH {REFERENCE} SELECT DISTINCT unnest(words) AS name FROM looked
    WHERE full_id IS NOT NULL AND len(mapped) = 0"""
)
def unmapped_labels(spark, sf):
    return R.unmapped_labels(*reference_inputs(spark, sf), WORD_MAP)


@query(f"WITH {STRATIFIED} SELECT doc_id, split FROM s")
def split_data_fallback(spark, sf):
    """Homology asked for without clusters: stratified by the first label."""
    d = table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("locations"))
    return W.split_data(d, "homology", key="doc_id").select("doc_id", "split")


@query(
    f"SELECT doc_id, {key_sql(42, 'doc_id')} AS order_key, md5('7|' || lang || '|' || doc_id) AS k "
    "FROM documents"
)
def stable_keys(spark, sf):
    from seqtables.functions.keys import order_key

    return table(spark, sf, "documents").select(
        "doc_id",
        order_key(42, F.col("doc_id")).alias("order_key"),
        stable_key(7, F.col("lang"), F.col("doc_id")).alias("k"),
    )



