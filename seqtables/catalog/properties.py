"""Catalog: numeric sequence properties and feature blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.catalog.base import DOCS, docs, r6, registry, table
from seqtables.functions import features as X
from seqtables.functions import properties as B
from seqtables.functions.sequences import clean_sequence
from seqtables.operators import scaling

Q, SQL, query = registry()

CLEAN = f"""{DOCS}, clean AS (SELECT doc_id, regexp_replace(sequence, '[^{P.RESIDUES}]', '', 'g') AS s
 FROM docs), n AS (SELECT doc_id, s, length(s) AS len FROM clean)"""


def n_of(a: str) -> str:
    return f"(len - length(replace(s, '{a}', '')))"


def n_in(letters: str) -> str:
    return "(" + " + ".join(n_of(a) for a in letters) + ")"


def total(weights: dict) -> str:
    return "(" + " + ".join(f"{n_of(a)} * CAST({w} AS DOUBLE)" for a, w in weights.items()) + ")"


def pk_case(letter: str, table_: dict, default: float) -> str:
    whens = " ".join(f"WHEN '{a}' THEN {pk}" for a, pk in table_.items())
    return f"CAST(CASE {letter} {whens} ELSE {default} END AS DOUBLE)"


N_TERM = pk_case("substr(s, 1, 1)", P.PK_N_TERM, P.PK_N_TERM_DEFAULT)
C_TERM = pk_case("substr(s, len, 1)", P.PK_C_TERM, P.PK_C_TERM_DEFAULT)


def charge_sql(ph: str, counts=n_of, n_term: str = N_TERM, c_term: str = C_TERM) -> str:
    plus = [f"1.0 / (pow(10.0, {ph} - {n_term}) + 1.0)"] + [
        f"{counts(a)} / (pow(10.0, {ph} - {pk}) + 1.0)" for a, pk in P.PK_POSITIVE.items()
    ]
    minus = [f"1.0 / (pow(10.0, {c_term} - {ph}) + 1.0)"] + [
        f"{counts(a)} / (pow(10.0, {pk} - {ph}) + 1.0)" for a, pk in P.PK_NEGATIVE.items()
    ]
    return f"(({' + '.join(plus)}) - ({' + '.join(minus)}))"


def guarded(value: str, places: int = 6) -> str:
    return f"CASE WHEN len >= 5 THEN round({value}, {places}) ELSE CAST('NaN' AS DOUBLE) END"


@query(
    f"WITH {CLEAN} SELECT doc_id, "
    + ", ".join(f"{n_of(a)} AS n_{a}" for a in P.RESIDUES)
    + " FROM n"
)
def residue_counts(spark, sf):
    return B.with_residue_counts(docs(spark, sf)).select(
        "doc_id", *[B.n_of(a).cast("bigint").alias(f"n_{a}") for a in P.RESIDUES]
    )


@query(
    f"""WITH {CLEAN} SELECT doc_id,
    {guarded(total(P.RESIDUE_MASS) + f" - (len - 1) * {P.WATER_MASS}")} AS molecular_weight,
    {guarded(total({a: round(v * 10) for a, v in P.HYDROPATHY.items()}) + " / 10.0 / len")} AS gravy,
    {guarded(f"CAST({n_in(P.AROMATIC)} AS DOUBLE) / len")} AS aromaticity,
    {guarded(charge_sql("7.0"))} AS charge_at_ph7,
    {guarded(f"CAST({n_in(P.HELIX)} AS DOUBLE) / len")} AS helix_fraction,
    {guarded(f"CAST({n_in(P.TURN)} AS DOUBLE) / len")} AS turn_fraction,
    {guarded(f"CAST({n_in(P.SHEET)} AS DOUBLE) / len")} AS sheet_fraction,
    {guarded("CAST(len AS DOUBLE)")} AS sequence_length, CAST('NaN' AS DOUBLE) AS unknown FROM n"""
)
def sequence_properties(spark, sf):
    names = [n for n in B.PROPERTIES if n != "isoelectric_point"] + ["unknown"]
    rows = B.sequence_properties(docs(spark, sf), "sequence", names)
    return rows.select("doc_id", *[r6(n).alias(n) for n in names])


COUNTED = ", ".join(
    f"CAST({n_of(a)} AS DOUBLE) AS k_{a}" for a in [*P.PK_POSITIVE, *P.PK_NEGATIVE]
)


@query(
    f"""WITH RECURSIVE {CLEAN}, g AS (SELECT doc_id, len, {N_TERM} AS nt, {C_TERM} AS ct, {COUNTED}
    FROM n), halving AS (SELECT *, CAST({P.PH_BRACKET[0]} AS DOUBLE) AS lo,
     CAST({P.PH_BRACKET[1]} AS DOUBLE) AS hi, 0 AS step FROM g UNION ALL
     SELECT * EXCLUDE (lo, hi, step, pos), CASE WHEN pos THEN (lo + hi) / 2 ELSE lo END,
      CASE WHEN pos THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM (SELECT *,
      {charge_sql("((lo + hi) / 2)", lambda a: f"k_{a}", "nt", "ct")} > 0 AS pos FROM halving)
      WHERE step < 17)
    SELECT doc_id, {guarded("(lo + hi) / 2", 4)} AS isoelectric_point FROM halving WHERE step = 17"""
)
def isoelectric_point(spark, sf):
    rows = B.sequence_properties(docs(spark, sf), "sequence", ["isoelectric_point"])
    return rows.select("doc_id", F.round("isoelectric_point", 4).alias("isoelectric_point"))


# Dipeptide weights by rule for the check; the operator takes any table of weights.
RULE_WEIGHTS = {
    a + b: round(P.HYDROPATHY[a] * P.HYDROPATHY[b], 2) for a in P.RESIDUES for b in P.RESIDUES
}
KD_LIST = "[" + ", ".join(str(P.HYDROPATHY[a]) for a in P.RESIDUES) + "]"


@query(
    f"""WITH {CLEAN}, codes AS (SELECT doc_id, len, list_transform(string_split(s, ''),
     lambda c: CAST({KD_LIST}[instr('{P.RESIDUES}', c)] AS DOUBLE)) AS v FROM n)
    SELECT doc_id, CASE WHEN len >= 5 THEN round(10.0 / len * list_sum(list_transform(range(1, len),
     lambda i: v[i] * v[i + 1])), 6) ELSE CAST('NaN' AS DOUBLE) END AS instability_index FROM codes"""
)
def instability_index(spark, sf):
    rows = B.sequence_properties(
        docs(spark, sf), "sequence", ["instability_index"], RULE_WEIGHTS
    )
    return rows.select("doc_id", r6("instability_index").alias("instability_index"))


KD_TENTHS = "[" + ", ".join(str(round(P.HYDROPATHY[a] * 10)) for a in P.RESIDUES) + "]"


@query(
    f"""WITH {DOCS}, letters AS (SELECT doc_id, length(sequence) AS len,
     unnest(string_split(sequence, '')) AS c, unnest(range(1, length(sequence) + 1)) AS i FROM docs),
    k AS (SELECT doc_id, len, i, CASE WHEN instr('{P.RESIDUES}', c) > 0
     THEN {KD_TENTHS}[instr('{P.RESIDUES}', c)] ELSE 0 END AS v FROM letters),
    w AS (SELECT *, sum(v) OVER (PARTITION BY doc_id ORDER BY i ROWS 18 PRECEDING) AS s FROM k),
    d AS (SELECT doc_id, any_value(len) AS len, sum(v) FILTER (i BETWEEN 2 AND 25) AS head,
     max(s) FILTER (i >= 19) AS best FROM w GROUP BY doc_id)
    SELECT doc_id, CAST(len >= 25 AND head > 240 AS DOUBLE) AS signal_peptide,
     CAST(len >= 19 AND best > 304 AS DOUBLE) AS transmembrane, 0.0::DOUBLE AS absent FROM d"""
)
def aux_targets(spark, sf):
    return docs(spark, sf).select(
        "doc_id",
        *B.aux_targets(F.col("sequence"), order=("signal_peptide", "transmembrane", "absent")),
    )


@query(
    """WITH v AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS a,
     CASE WHEN event_type = 'click' THEN CAST(user_id AS DOUBLE) END AS b, NULL::DOUBLE AS c
     FROM events)
    SELECT event_id, round(coalesce(a, avg(a) OVER ()), 6) AS a,
     round(coalesce(b, avg(b) OVER ()), 6) AS b, 0.0::DOUBLE AS c FROM v"""
)
def impute_mean(spark, sf):
    nan = F.lit(float("nan"))
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", nan).otherwise(F.col("value")).alias("a"),
        F.when(F.col("event_type") == "click", F.col("user_id").cast("double")).alias("b"),
        nan.alias("c"),
    )
    out = scaling.impute_mean(rows, ["a", "b", "c"])
    return out.select("event_id", r6("a").alias("a"), r6("b").alias("b"), r6("c").alias("c"))


@query(
    """WITH v AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS a,
     CAST(user_id AS DOUBLE) AS b FROM events),
    f AS (SELECT event_id, coalesce(a, avg(a) OVER ()) AS a, b FROM v)
    SELECT event_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) + 0.0 AS a,
     round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) + 0.0 AS b, 0.0::DOUBLE AS c FROM f"""
)
def standardize(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("a"),
        F.col("user_id").cast("double").alias("b"),
        F.lit(3.0).alias("c"),
    )
    out = scaling.standardize(rows, ["a", "b", "c"])
    return out.select(
        "event_id", *[(r6(c) + 0.0).alias(c) for c in ("a", "b", "c")]
    )


@query(
    f"""WITH {CLEAN}, f AS (SELECT doc_id, len, CASE WHEN len >= 5 THEN CAST({n_in(P.AROMATIC)} AS
     DOUBLE) / len ELSE 0 END AS aromaticity, CAST(quality AS DOUBLE) AS quality,
     CAST(toxic AS DOUBLE) AS toxic FROM n LEFT JOIN labels USING (doc_id))
    SELECT doc_id, array_to_string(list_transform([aromaticity, CAST(len AS DOUBLE),
     coalesce(quality, 0.0), coalesce(toxic, 0.0)], lambda x: printf('%.6f', round(x, 6))), ',')
     AS features FROM f"""
)
def concat_features(spark, sf):
    rows = B.sequence_properties(
        docs(spark, sf).withColumn("n_residues", F.length(clean_sequence(F.col("sequence")))),
        "sequence",
        ["aromaticity"],
    ).withColumn("aromaticity", F.nanvl("aromaticity", F.lit(0.0)))
    tool = table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("has_sp"), F.col("toxic").alias("sp_prob")
    )
    enabled = {"biophysical": True, "signal_peptide": True}
    features = X.concat_features(enabled, ["aromaticity", "n_residues"])
    text = F.array_join(F.transform(features, lambda x: F.format_string("%.6f", F.round(x, 6))), ",")
    return rows.join(tool, "doc_id", "left").select("doc_id", text.alias("features"))
