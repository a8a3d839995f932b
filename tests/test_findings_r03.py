"""Queries on tables of odd rows and layouts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqtables import catalog
from seqtables.operators import similarity as Sim
from seqtables.operators.clean import sequence_from_text
from seqtables.plans.embed import embed_rows
from seqtables.sources.store import embedding_store

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, folder, texts):
    rows = [(i, t, "en", "x", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("one_file", [False, True])
def test_score_stream_reads_a_table_of_any_files(spark, tmp_path, one_file):
    sf = documents(spark, tmp_path / "folder", ["M" * n for n in range(30)] + [None])
    if one_file:
        sf = str(tmp_path)
        table = spark.read.parquet(f"{tmp_path}/folder/documents.parquet").toPandas()
        table["n_chars"] = table["n_chars"].astype("Int64")
        table.to_parquet(f"{sf}/documents.parquet", index=False)
    found = catalog.queries()["score_stream"](spark, sf)
    told = {r["doc_id"]: r["outcome"] for r in found.collect()}
    assert told == {i: "too_short" if i < 10 else "scored" for i in range(30)} | {30: "missing"}


def test_aggregate_chunks_takes_texts_without_letters_and_reads_texts_once(spark, tmp_path):
    sf = documents(spark, tmp_path, ["EN", "12 34", "", "E" * 400, None])
    found = catalog.queries()["aggregate_chunks"](spark, sf)
    rows = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert rows == {0: (0.5,) * 6, 1: (None,) * 6, 2: (None,) * 6, 3: (1, 0) * 3}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan


def counted(spark, texts):
    """Rows of the texts and the number of times one was derived."""
    seen = spark.sparkContext.accumulator(0)

    def note(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame(list(enumerate(texts)), "accession int, raw string")
    noted = F.udf(note, "string").asNondeterministic()
    return rows.select("accession", noted("raw").alias("sequence")), seen


def test_cluster_similar_derives_its_input_once(spark):
    texts = ["ACDEFGHIKL" * 4, "ACDEFGHIKL" * 4 + "M", "MNPQRSTVWY" * 4, None, "A", "ACDEFGHIKL" * 4]
    rows, seen = counted(spark, texts)
    found = dict(Sim.cluster_similar(rows).collect())
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 0}
    assert seen.value == len(texts)


def test_forest_leaves_reached_rows_alone():
    asked = []

    def partners(i, x):
        asked.append(len(x))
        return x

    assert Sim.forest(100, partners) == [(0, j) for j in range(1, 100)]
    assert sum(asked) == 99


def test_pairs_of_an_earlier_bucket_are_marked():
    met = Sim.met_before(pa.array([[1, 2], [3], [2], [], [3, 2]]), 5)
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(met)) if i < j}
    assert pairs == {(0, 2), (0, 4), (1, 4), (2, 4)}


def test_embedding_store_derives_its_rows_once(spark, tmp_path):
    rows, seen = counted(spark, ["AAA", "CCC", "AAA", None])

    def encode(new):
        return embed_rows(new, lambda: lambda texts: [[float(len(t))] for t in texts])

    out, added = embedding_store(rows, encode, str(tmp_path / "store"), "letters")
    found = {r["accession"]: r["embedding"] for r in out.collect()}
    assert found == {0: [3], 1: [3], 2: [3], 3: None} and added == 3
    assert seen.value == 4


def test_rare_codes_are_mapped_after_case(spark):
    rows = spark.createDataFrame([("b-J oézZ1\nK",), ("",), (None,)], "t string")
    found = [r["s"] for r in rows.select(sequence_from_text(F.col("t")).alias("s")).collect()]
    assert found == ["NLKQQK", "", None]
