"""The pipeline stage by stage against plain Python, and its edges."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqtables.llm.tables import stored


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        out[name] = docs
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "benchmark", "secrets", "pack"]
    for name in names[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality_keeps_good_documents(stages, duck):
    labels = dict(duck.sql("select doc_id, quality from labels").fetchall())
    kept = texts(stages["quality"])
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert len(kept) < stages["documents"].count()


def test_near_copies_leave_one_of_each_group(stages):
    before, after = texts(stages["quality"]), texts(stages["near_copies"])

    def grams(text):
        words = re.findall("[^\x20\x09-\x0d]+", text.lower())
        size = min(5, len(words))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()

    sets = {d: grams(t) for d, t in before.items()}

    def close(a, b):
        a, b = sets[a], sets[b]
        return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)

    kept = sorted(after)
    assert not any(close(a, b) for i, a in enumerate(kept) for b in kept[:i])
    for gone in before.keys() - after.keys():
        group, todo = {gone}, [gone]
        while todo:
            at = todo.pop()
            more = [d for d in before if d not in group and close(at, d)]
            group |= set(more)
            todo += more
        assert min(group) in after and min(group) != gone


def test_benchmark_passages_are_gone(stages, duck):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for (text,) in duck.sql("select text from benchmark").fetchall():
        words = word.findall(text.lower())
        windows |= {tuple(words[i : i + 10]) for i in range(len(words) - 9)}

    def hits(frame):
        found = 0
        for text in texts(frame).values():
            words = word.findall(text.lower())
            found += any(tuple(words[i : i + 10]) in windows for i in range(len(words) - 9))
        return found

    assert hits(stages["near_copies"]) > 0 and hits(stages["benchmark"]) == 0
    lengths = stages["benchmark"].filter(F.col("n_chars") != F.length("text")).count()
    assert lengths == 0


def test_secrets_are_marked(stages):
    before, after = texts(stages["benchmark"]), texts(stages["secrets"])
    assert before.keys() == after.keys()
    assert not any(re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", t) for t in after.values())
    changed = [d for d in before if before[d] != after[d]]
    assert all("[secret]" in after[d] for d in changed)


def test_packing_holds_every_kept_document(stages):
    assert texts(stages["secrets"]).keys() == {r["doc_id"] for r in stages["pack"].collect()}


def test_edges_pass_every_stage(spark, sf):
    rows = [(1, None), (2, ""), (3, "tiny"), (4, "tiny"), (5, "w " * 100_000), (None, "tiny"), (6, "same"), (6, "same")]
    full = [(i, t, None, "s", 0, "x", 1) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, blob string, row_id int"
    for some in (full, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stored(stage(spark, docs, sf), f"test-edge-{name}")
            assert name == "pack" or docs.columns == columns
    ids = spark.createDataFrame(full, schema)
    kept = corpus_pipeline.drop_near_copies(spark, ids, sf).collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == ["1", "2", "3", "5", "6", "None"]
