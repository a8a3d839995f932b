"""Trained scores: accuracy on held-out rows, features by hand, and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtables.llm import catalog, quality, toxicity
from seqtables.llm.tables import held_out
from seqtables.llm.words import ALNUM, WordHasher

LARGER = "/root/testdata/sf0.1"


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def outcome(spark, name, label):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label)
    rows = catalog.queries()[name](spark, LARGER).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    right = {1: [], 0: []}
    for r in tested:
        right[r[label]].append(r["predicted"] == r[label])
    return np.mean(right[1]), np.mean(right[0])


def test_quality_on_held_out_rows(spark):
    good, bad = outcome(spark, "op9_quality", "quality")
    assert good >= 0.98 and bad >= 0.95


def test_toxicity_on_held_out_rows(spark):
    toxic, clean = outcome(spark, "op6_toxicity", "toxic")
    assert toxic >= 0.8 and clean >= 0.99


def scores(spark, which, docs, labels):
    learn = ~held_out(F.col("row_id"))
    run = quality.quality_scores if which == "quality" else toxicity.toxicity_scores
    table = spark.createDataFrame(labels, "doc_id long, y double, text string")
    rows = run(docs, table, "doc_id", "text", "y", learn).collect()
    return [(r["row_id"], r["score"]) for r in rows]


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_edges(spark, docs, which):
    texts = [(1, None), (2, ""), (3, "a b c " * 30_000), (None, "x y"), (5, "same"), (5, "same"), (6, "!!")]
    labels = [(i, float(i % 2), "clash") for i in range(1, 7)] + [(1, None, ""), (None, 1.0, "")]
    found = scores(spark, which, docs(texts), labels)
    assert len(found) == len(texts) and all(0 <= s <= 1 for _, s in found)
    by_id = dict(found)
    assert by_id[1] == by_id[2]
    assert len({s for i, s in found if i == 5}) == 1
    none = scores(spark, which, docs(texts), [])
    assert {s for _, s in none} == {0.5}
    assert scores(spark, which, docs([]), labels) == []
    same = scores(spark, which, docs(texts), [(i, 1.0, "") for i in range(1, 7)])
    assert len(same) == len(texts) and all(0.4 <= s <= 1 for _, s in same)


def test_ridge_approximates_the_kernel():
    rows = np.random.default_rng(1).normal(size=(6, 4))
    phi = quality.fourier(rows, 20_000, 0.05, 3)[:, :-1]
    gap = ((rows[:, None] - rows[None]) ** 2).sum(-1)
    assert np.abs(phi @ phi.T - np.exp(-0.05 * gap)).max() < 0.03


def test_pool_adjacent_is_monotone_and_keeps_the_mean():
    draw = np.random.default_rng(2)
    n = draw.integers(1, 9, 40).astype(float)
    ones = np.floor(n * draw.uniform(size=40))
    knots, values = quality.pool_adjacent(np.arange(40.0), ones, n)
    fit = np.interp(np.arange(40.0), knots, values)
    assert (np.diff(fit) >= -1e-12).all()
    assert abs((fit * n).sum() - ones.sum()) < 1e-9


def test_ftrl_matches_the_update_rule_written_out():
    rows = [np.array([0, 2]), np.array([1, 2]), np.array([0, 2])]
    y = np.array([1.0, 0.0, 1.0])
    z, n = np.zeros(3), np.zeros(3)
    toxicity.ftrl_pass(rows, y, z, n, np.array([0, 1, 2]))
    zz, nn = [0.0] * 3, [0.0] * 3
    for at, label in zip(rows, y):
        w = []
        for i in at:
            rate = (toxicity.BETA + nn[i] ** 0.5) / toxicity.ALPHA + toxicity.L2
            if i == 2:
                w.append(-zz[i] / rate)
            elif abs(zz[i]) <= toxicity.L1:
                w.append(0.0)
            else:
                w.append(-(zz[i] - np.sign(zz[i]) * toxicity.L1) / rate)
        g = 1 / (1 + np.exp(-sum(w))) - label
        for i, wi in zip(at, w):
            zz[i] += g - ((nn[i] + g * g) ** 0.5 - nn[i] ** 0.5) / toxicity.ALPHA * wi
            nn[i] += g * g
    assert np.allclose(z, zz) and np.allclose(n, nn)


def test_word_heads_and_blocks():
    hasher = WordHasher(ALNUM, heads=(3,))
    a, b, c = (list(hasher.texts([t]))[0] for t in ("Alpha", "alpine", "al"))
    assert a[0][0] != b[0][0] and a[1][0] == b[1][0]
    assert c[0][0] == c[1][0]
    long = "word " * 500_000 + "x" * 3_000_000 + " end"
    parts = list(hasher.texts([long, "", None, "word"]))
    assert [p.shape[1] for p in parts] == [500_002, 0, 0, 1]
    assert len(np.unique(parts[0][0])) == 3 and parts[3][0][0] == parts[0][0][0]


def test_words_of_one_family_do_not_collide():
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < 4096:
        word += word.translate(swap)
        hashes = list(WordHasher().texts([f"{word} {word.translate(swap)} {word}"]))[0]
        assert hashes[0] == hashes[2] != hashes[1]


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_texts_that_share_an_id_give_one_model_in_any_order(spark, docs, which):
    texts = [(i % 40, f"{'bad' if i % 2 else 'good'} word{i % 7} text{i} " * (1 + i % 5)) for i in range(160)]
    labels = [(i, float(i % 2), "") for i in range(40)]
    runs = [sorted(scores(spark, which, docs(rows), labels)) for rows in (texts, texts[::-1])]
    assert runs[0] == runs[1]
