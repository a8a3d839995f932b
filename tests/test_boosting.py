"""Histogram boosting: sums and cuts by definition, one model in tasks and in passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtables.plans import models as M
from seqtables.plans import boosting as B
from seqtables.plans.boosting import SCALE, Settings, Sums, best_cuts, gradients, grow_class, histograms


def rows(spark, n=400, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 20, (n, 4)).astype(float)
    y = np.stack((x[:, 0] > 9, (x[:, 1] > 9) != (x[:, 2] > 12), x[:, 3] > 99), axis=1).astype(int)
    data = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, features array<double>, y array<int>"), x, y


def same(a, b):
    return all(
        m == k if isinstance(m, float) else
        (m.feature == k.feature).all() and (m.cut == k.cut).all() and (m.leaf == k.leaf).all()
        for m, k in zip(a.models, b.models)
    )


def test_fits_what_one_cut_cannot(spark):
    frame, x, y = rows(spark)
    scorer = M.boosted_trees(frame, ["a", "b", "c"], n_trees=40, depth=3)
    out = {r["id"]: r["preds"] for r in M.decide(M.add_logits(frame, scorer), scorer).collect()}
    assert (np.array([out[i] for i in range(len(y))]) == y).mean() > 0.99
    assert scorer.models[2] == -M.CONSTANT_LOGIT


@pytest.mark.parametrize("parts", [1, 7])
def test_tasks_and_passes_give_the_same_trees(spark, parts):
    frame = rows(spark)[0]
    # More rounds than margins are kept for, and another dealing of the rows.
    limits = {"n_trees": 10, "depth": 3, "bins": 16}
    one = M.boosted_trees(frame, ["a", "b", "c"], **limits)
    many = M.boosted_trees(frame.repartition(parts), ["a", "b", "c"], task_cells=0, **limits)
    assert same(one, many)


def test_cuts_by_definition():
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 8, (300, 3)).astype(np.uint8), draw.integers(0, 2, 300)
    s = Settings(1, 1, 0.1, 8, 1.0, 1.0, 3)
    sums = gradients(draw.normal(size=300), y, 1.7)
    node = draw.integers(-1, 2, 300)
    hist = histograms(x, node, sums, 2, s)
    for i, (f, b, gl, hl, gr, hr) in enumerate(best_cuts(hist, s)):
        gains = {}
        for feature in range(3):
            for cut in range(7):
                left = (node == i) & (x[:, feature] <= cut)
                right = (node == i) & (x[:, feature] > cut)
                a, c = (sums[:, k].sum(axis=1) / SCALE for k in (left, right))
                if min(a[1], c[1]) >= 1:
                    worth = [p[0] ** 2 / (p[1] + 1) for p in (a, c, a + c)]
                    gains[feature, cut] = (worth[0] + worth[1] - worth[2]) / 2
        assert gains[f, b] == pytest.approx(max(gains.values()))
        left = (node == i) & (x[:, f] <= b)
        assert (gl, hl) == tuple(sums[:, left].sum(axis=1))
        assert gr + gl == sums[0, node == i].sum() and hr + hl == sums[1, node == i].sum()


def test_odd_values(spark, tmp_path):
    nan = float("nan")
    data = [
        (0, [1.0, 5.0, nan], [1, 0]), (1, [2.0, 5.0, None], [1, None]), (2, [3.0, 5.0, 1.0], [0, 1]),
        (3, [4.0, 5.0, 1.0], [0, 1]), (4, [1.0, 5.0, nan], [1, 0]), (5, [9.0, 5.0, 2.0], [0, 1]),
    ] * 4
    frame = spark.createDataFrame(data, "id long, features array<double>, y array<int>")
    scorer = M.boosted_trees(frame, ["a", "b"], n_trees=20, depth=2)
    scored = M.add_logits(frame, scorer)
    got = {r["id"]: [v > 0 for v in r["logits"]] for r in scored.collect()}
    assert got == {i: [not v, v] for i, v in [(0, False), (1, False), (2, True), (3, True), (4, False), (5, True)]}
    assert all((m.feature[np.isfinite(m.cut)] != 1).all() for m in scorer.models)
    M.save_scorer(spark, scorer, str(tmp_path), "trees")
    again = M.load_scorer(spark, str(tmp_path))
    assert same(scorer, again)
    both = scored.select("id", "logits").exceptAll(M.add_logits(frame, again).select("id", "logits"))
    assert both.isEmpty()


def test_missing_labels_and_trees_beside_other_models(spark):
    frame = rows(spark, 60)[0].withColumn("y", F.when(F.col("id") > 2, F.col("y")))
    trees = M.boosted_trees(frame, ["a", "b", "c"], n_trees=2, depth=2)
    line = M.linear_probe(frame.filter("id > 2"), ["a", "b", "c"], max_iter=5)
    mixed = M.Scorer(["a", "b", "c"], [trees.models[0], line.models[1], -3.0])
    for r in M.add_logits(frame, mixed).collect():
        assert len(r["logits"]) == 3 and r["logits"][2] == -3.0


def test_no_rows_to_score(spark):
    frame = rows(spark, 30)[0]
    scorer = M.boosted_trees(frame, ["a", "b", "c"], n_trees=1, depth=1)
    assert M.add_logits(frame.limit(0), scorer).count() == 0


@pytest.mark.parametrize("n, width, bins", [(900, 5, 16), (900, 4, 8), (60, 1, 8), (40, 3, 256)])
def test_sums_of_one_task_are_the_histograms(n, width, bins):
    draw = np.random.default_rng(5)
    s = Settings(1, 2, 0.1, bins, 1.0, 1.0, width)
    x = draw.integers(0, bins, (n, width)).astype(np.uint8)
    sums = np.rint(draw.normal(size=(2, n)) * SCALE)
    place = draw.integers(-1, 2, n)
    rows = np.flatnonzero(place >= 0)
    found = Sums(x, s).add(rows, place[rows], sums[:, rows], 2)
    assert (found == histograms(x, place, sums, 2, s)).all()
    whole = Sums(x, s).add(None, np.zeros(n, np.int64), sums, 1)
    assert (whole == histograms(x, np.zeros(n, np.int64), sums, 1, s)).all()


def test_a_level_sums_the_smaller_children_only(monkeypatch):
    summed, add = [], Sums.add

    def noted(self, rows, rank, sums, nodes):
        summed.append(len(rank))
        return add(self, rows, rank, sums, nodes)

    monkeypatch.setattr(Sums, "add", noted)
    draw = np.random.default_rng(7)
    x = draw.integers(0, 16, (2000, 4)).astype(np.uint8)
    y = (x[:, 0] > 9) != (x[:, 1] > 5)
    s = Settings(3, 4, 0.1, 16, 1.0, 1.0, 4)
    trees = list(grow_class(x, y.astype(int), 1.0, s))
    assert len(summed) > 3 and summed.count(2000) == 3
    assert all(n <= 1000 for n in summed if n < 2000)
    margin = np.zeros(2000)
    for tree in trees:
        # The same tree by whole sums of every level.
        again, sums = B.Growing(s), gradients(margin, y, 1.0)
        for level in range(4):
            if not again.open:
                break
            node = again.ranks(again.places(x, level))
            again.add(level, best_cuts(histograms(x, node, sums, len(again.open), s), s))
        assert (again.feature == tree.feature).all() and (again.bin == tree.bin).all()
        assert (again.leaf == tree.leaf).all()
        margin += tree.values(x)
