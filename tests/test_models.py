"""Linear fits, bundles, the run ledger, the benchmark's counts and the encoder's batches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtables.plans import embed as E
from seqtables.plans import models as M
from seqtables.plans.features import FeatureModel, FeatureStage
from seqtables.plans.linear import LinearModel


def labelled(spark, n=300, seed=4):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3)) * [1, 5, 0.2]
    y = np.stack([(x @ w + draw.normal(size=n) > b) for w, b in (([1, 0.2, 0], 0.5), ([0, -0.3, 4], 1))], axis=1)
    rows = [(i, a.tolist(), [int(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, y array<int>"), x, y.astype(float)


def newton(x, y, w, c):
    """The optimum by second derivatives, for comparison."""
    full, point = np.hstack((x, np.ones((len(x), 1)))), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1 / c] * x.shape[1] + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ point))
        gradient = full.T @ (w * (p - y)) + ridge @ point
        point -= np.linalg.solve(full.T @ (full * (w * p * (1 - p))[:, None]) + ridge, gradient)
    return point


@pytest.mark.parametrize("balanced,c", [(True, 1.0), (False, 0.1)])
def test_linear_probe_reaches_the_optimum(spark, balanced, c):
    frame, x, y = labelled(spark)
    scorer = M.linear_probe(frame.repartition(5), ["a", "b"], c=c, balanced=balanced)
    for i, model in enumerate(scorer.models):
        p = y[:, i].sum()
        w = np.where(y[:, i] == 1, len(y) / (2 * p), len(y) / (2 * (len(y) - p))) if balanced else np.ones(len(y))
        want = newton(x, y[:, i], w, c)
        assert np.abs(np.append(model.coef, model.intercept) - want).max() < 1e-3
    norms = M.probe_gradients(frame, scorer, c, balanced).collect()
    assert len(norms) == 2 and all(r["gradient"] < 1e-5 for r in norms)
    off = M.Scorer(scorer.labels, [LinearModel(m.coef + 0.5, m.intercept) for m in scorer.models])
    assert all(r["gradient"] > 1e-3 for r in M.probe_gradients(frame, off, c, balanced).collect())


def test_linear_fit_sums_in_a_stage_as_on_the_driver(spark, monkeypatch):
    from seqtables.plans import linear

    frame = labelled(spark)[0].repartition(6)
    one = M.linear_probe(frame, ["a", "b"])
    monkeypatch.setattr(linear, "DIRECT_BYTES", 0)
    two = M.linear_probe(frame, ["a", "b"])
    for a, b in zip(one.models, two.models):
        assert np.abs(a.coef - b.coef).max() < 1e-6


def fixed(value):
    return M.Scorer(["a", "b"], [LinearModel(np.array([value, 0.0]), 0.0), -1.5])


def test_bundles_are_whole_or_unseen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    with pytest.raises(FileNotFoundError):
        M.load_scorer(spark, root)
    first = M.save_scorer(spark, fixed(1.0), root, "same")

    def cut_off(*args):
        raise OSError("disk gone")

    with monkeypatch.context() as m:
        m.setattr(M, "save_class_params", cut_off)
        params = spark.createDataFrame([(0, 0.4)], "label_idx int, threshold double")
        with pytest.raises(OSError):
            M.save_scorer(spark, M.Scorer(["a"], [1.0], thresholds=params), root, "same")
    # The torn folder is there, but no reader meets it.
    torn = [p for p in (tmp_path / "root" / "bundles").iterdir() if not first.endswith(p.name)]
    assert len(torn) <= 1 and M.newest_bundle(spark, root) == first
    assert M.load_scorer(spark, root).models[0].coef.tolist() == [1.0, 0.0]
    with pytest.raises(FileNotFoundError):
        M.load_scorer(spark, root, path=f"{root}/bundles/none")
    second = M.save_scorer(spark, fixed(2.0), root, "same")
    assert first != second and M.newest_bundle(spark, root) == second
    # The first bundle is still there under its own path.
    assert M.load_scorer(spark, root, path=first).models[0].coef[0] == 1.0


def test_equal_times_have_one_newest_bundle(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"{root}/bundles/x{i}", "x", 0) for i in (2, 3, 1)]
    for part in (rows, rows[::-1]):
        frame = spark.createDataFrame(part, "path string, name string, t long")
        frame.select("path", "name", F.timestamp_seconds("t").alias("saved_at")).write.mode(
            "overwrite"
        ).parquet(f"{root}/registry")
        assert M.newest_bundle(spark, root) == f"{root}/bundles/x3"


def test_matrix_resumes(spark, tmp_path):
    calls, path = [], str(tmp_path / "matrix")

    def run(params, folder):
        calls.append(params["c"])
        if params["c"] == 3 and calls.count(3) == 1:
            raise RuntimeError("no memory")
        (tmp_path / "out.txt").write_text(json.dumps({"folder": folder}))
        return spark.createDataFrame([(params["c"] / 10,)], "f1_macro double")

    variants = {f"c{c}": M.Variant({"c": c}, run) for c in (1, 2, 3)}
    first = {r["tag"]: r for r in M.run_matrix(spark, variants, path).collect()}
    assert [first[t]["status"] for t in ("c1", "c2", "c3")] == ["ok", "ok", "failed"]
    assert "no memory" in first["c3"]["error"] and len({r["folder"] for r in first.values()}) == 3
    again = {r["tag"]: r for r in M.run_matrix(spark, variants, path).collect()}
    assert calls == [1, 2, 3, 3] and again["c3"]["status"] == "ok"
    assert again["c1"]["folder"] == first["c1"]["folder"] != again["c3"]["folder"]
    # Changed parameters are a run of their own.
    variants["c1"] = M.Variant({"c": 9}, run)
    last = M.run_matrix(spark, variants, path)
    assert calls[-1] == 9 and last.count() == 3
    assert [r["tag"] for r in M.best_runs(last, 2).collect()] == ["c1", "c3"]
    lines = [r["line"] for r in M.matrix_report(last, 1).orderBy("line_no").collect()]
    assert lines[0].startswith("| Run | Rank | Status | f1_macro") and lines[2].startswith("| c1 | best | ok | 0.900 |")
    assert lines[4] == "| c2 |  | ok | 0.200 | — | — | — | — | — |"


def test_benchmark_counts_what_it_skips(spark):
    rows = [
        ("1", "AAAA", ["a"]), ("2", None, ["a"]), ("3", "", ["b"]), ("4", "AACC", ["zzz"]),
        ("5", "CCCC", []), ("6", "CCCA", None), ("7", "CAAA", ["b", "zzz"]), ("8", None, None),
    ]
    reference = spark.createDataFrame(rows, "accession string, sequence string, locations array<string>")

    def encode(df):
        share = F.length(F.translate("sequence", "C", "")) / F.length("sequence")
        return df.withColumn("features", F.array(share, F.lit(0.0)))

    overall, per_class = M.external_benchmark(reference, fixed(1.0), encode, "tool_predictions")
    row = overall.first()
    assert (row["n_source_rows"], row["n_samples"], row["reference_type"]) == (8, 2, "tool_predictions")
    assert (row["n_skipped_missing_sequence"], row["n_skipped_unmapped_labels"]) == (3, 3)
    assert {r["label"]: r["support"] for r in per_class.collect()} == {"a": 1, "b": 1}
    for part, n in ((reference.filter("accession IN ('2', '4')"), 2), (reference.limit(0), 0)):
        none = M.external_benchmark(part, fixed(1.0), encode)[0].first()
        assert none["n_source_rows"] == n and not none["n_samples"]


def test_encoder_batches_by_letters_and_keeps_columns(spark):
    assert list(E.letter_batches(["aa", "b", "cccccc", "d", "e"], 2, 4)) == [["aa", "b"], ["cccccc"], ["d", "e"]]

    def factory():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    rows = [(1, "AAAA", "x", [9.0]), (2, None, "y", None), (3, "A" * 500, "z", None), (3, "", None, None)]
    df = spark.createDataFrame(rows, "id int, sequence string, embedding string, extra array<double>").coalesce(1)
    out = E.embed_rows(df, factory, batch_letters=100, max_length=300)
    assert out.columns == ["id", "sequence", "extra", "embedding"]
    found = sorted(map(tuple, out.collect()), key=str)
    assert found == sorted(
        [(1, "AAAA", [9.0], [4.0, 1.0]), (2, None, None, None), (3, "A" * 500, None, [300.0, 1.0]), (3, "", None, [0.0, 1.0])],
        key=str,
    )
    assert E.embed_rows(df.limit(0), factory).count() == 0


def test_feature_stage_scales_with_training_values(spark, tmp_path):
    nan = float("nan")
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0), (nan, 5.0)], "size double, flat double")
    model = FeatureStage(["size", "flat", "gone"], ["has_sp", "sp_prob"], "ext").fit(
        train.withColumn("gone", F.lit(None).cast("double"))
    )
    model.write().save(str(tmp_path / "stage"))
    again = FeatureModel.load(str(tmp_path / "stage"))
    assert again.width == 5 and again.getOrDefault("means") == [2.0, 5.0, 0.0]
    rows = spark.createDataFrame(
        [(1, 4.0, 6.0, 1), (2, None, 5.0, None), (3, nan, None, 0)], "id int, size double, flat double, has_sp int"
    )
    found = {r["id"]: r["ext"] for r in again.transform(rows).collect()}
    # Two of four values are imputed, so the deviation is the square root of one half.
    assert found[1] == [pytest.approx(2 / 0.5**0.5), 1.0, 0.0, 1.0, 0.0]
    assert found[2] == [0.0, 0.0, 0.0, 0.0, 0.0] and found[3] == [0.0, 0.0, 0.0, 0.0, 0.0]
    # A table without the columns scores as if every value were missing.
    assert again.transform(rows.select("id")).first()["ext"] == [0.0] * 5


def test_bundle_with_a_stage(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0], 2.0), (2, [1.0], 4.0)], "id int, features array<double>, size double")
    scorer = M.Scorer(["a"], [LinearModel(np.array([0.5, 3.0]), 0.0)], stage=FeatureStage(["size"]).fit(frame))
    M.save_scorer(spark, scorer, str(tmp_path), "m")
    got = M.add_logits(frame, M.load_scorer(spark, str(tmp_path))).orderBy("id").collect()
    assert [r["logits"] for r in got] == [[-2.5], [3.5]]
