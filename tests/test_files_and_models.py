"""File formats, stores, models and the stream on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.operators import similarity as Sim
from seqtables.operators.metrics import comparison_table
from seqtables.plans import embed as E
from seqtables.plans import models as M
from seqtables.plans.prepare import prepare, prepare_splits
from seqtables.session import checkpoint_dir, scratch_path
from seqtables.sources import exchange as X
from seqtables.sources import reports as R
from seqtables.sources import store as St
from seqtables.sources import tables as T
from seqtables.streaming import scoring as S


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


class StubSession:
    """Just the settings the folder lookup reads."""

    def __init__(self, master, setting=None):
        self.master, self.setting, self.current = master, setting, None
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.setting if self.setting and key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


def test_checkpoint_folder_comes_from_the_session(spark):
    shared = StubSession("spark://host", "hdfs:///shared")
    assert checkpoint_dir(shared) == shared.current == "hdfs:///shared"
    assert scratch_path(shared, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(RuntimeError):
        checkpoint_dir(StubSession("spark://host"))
    assert checkpoint_dir(StubSession("local[2]"))
    assert checkpoint_dir(spark)


def test_raw_pages(spark, tmp_path):
    head = "Entry\tSequence\tSubcellular location [CC]\n"
    put(tmp_path / "p1.tsv", head + "A\tMSK\tNucleus\n")
    put(tmp_path / "p2.tsv", head + "B\tMSK\tCytoplasm\n")
    put(tmp_path / "none.tsv", head)
    assert T.read_raw(spark, [str(tmp_path / "p1.tsv"), str(tmp_path / "p2.tsv")]).count() == 2
    assert T.read_raw(spark, str(tmp_path / "none.tsv")).isEmpty()


def test_fasta(spark, tmp_path):
    path = put(
        tmp_path / "a.fasta",
        ">sp|P1|A first > record\nMSK\n GEEL \n\n>P2\r\nAAA\r\nCC\r\n>P3\n",
    )
    rows = X.read_fasta(spark, path).orderBy("ord").select("id", "description", "sequence").collect()
    assert [tuple(r) for r in rows] == [
        ("sp|P1|A", "sp|P1|A first > record", "MSKGEEL"),
        ("P2", "P2", "AAACC"),
        ("P3", "P3", ""),
    ]


def test_tool_results(spark, tmp_path):
    sp = put(tmp_path / "sp.txt", "# comment\n\nseq_0\tSP\t0.95\nseq_1\tOTHER\t0.05\nseq_9\tSP\n")
    tm = put(
        tmp_path / "tm.txt",
        "seq_0\tlen=33\tExpAA=15.0\tFirst60=1\tPredHel=1\nseq_1\tlen=34\tExpAA=0.0\tFirst60=0\tPredHel=0\n",
    )
    ids = spark.createDataFrame([("seq_0",), ("seq_1",), ("seq_2",)], "id string")
    rows = X.with_tool_features(ids, X.read_signal_peptide_results(spark, sp)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, 0.95), (0, 0.05), (0, 0)]
    rows = X.with_tool_features(ids, X.read_tm_results(spark, tm)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, 1, 15 / 33), (0, 0, 0), (0, 0, 0)]


def test_cluster_table(spark, tmp_path):
    path = put(tmp_path / "c.tsv", "Z\tZ\nZ\tA\nB\tB\n")
    rows = Sim.read_cluster_numbers(X.read_cluster_tsv(spark, path), "ordinal").collect()
    assert sorted(map(tuple, rows)) == [("A", 0), ("B", 1), ("Z", 0)]


FASTA = ">sp|P07221|CASQ1 x\nAAA\n>sp|P82413|RK19 y\nCCC\n>sp|P30952|MLS1 z\nDDD\n"
CSV = (
    "Protein_ID,Localizations,Signals\nsp|P07221|CASQ1,Extracellular|Endoplasmic reticulum,\n"
    "sp|P82413|RK19,Plastid,\nsp|P30952|MLS1,Peroxisome,\n"
)


def test_reference_set_choice(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        X.load_reference_set(spark, str(tmp_path / "none"))
    a = tmp_path / "a"
    put(a / "test.fasta", FASTA)
    with pytest.raises(FileNotFoundError):
        X.load_reference_set(spark, str(a))
    put(a / "outputs" / "results_test.csv", CSV)
    rows, meta = X.load_reference_set(spark, str(a))
    assert meta["reference_type"] == "tool_predictions" and meta["n_skipped_unmapped_labels"] == 1
    assert [r["name"] for r in meta["unmapped_labels"].collect()] == ["Plastid"] and rows.count() == 2
    b = tmp_path / "b"
    put(b / "test.fasta", FASTA)
    put(b / "test_labels.tsv", "P07221\tNucleus\n")
    rows, meta = X.load_reference_set(spark, str(b))
    assert meta["reference_type"] == "ground_truth_labels"
    assert rows.first()["accession"] == "sp|P07221|CASQ1"
    put(b / "test_labels.tsv", "P07221\tRabbit protein\n")
    with pytest.raises(RuntimeError):
        X.load_reference_set(spark, str(b))
    put(b / "test_labels.tsv", "P07221\n")
    with pytest.raises(ValueError):
        X.load_reference_set(spark, str(b))


def test_prediction_table_needs_its_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="Missing required columns"):
        X.read_prediction_csv(spark, put(tmp_path / "p.csv", "Protein_ID,x\na,b\n"))


def test_class_parameters(spark, tmp_path):
    table = spark.createDataFrame([(0, 0.3)], "label_idx int, threshold double")
    path = str(tmp_path / "t")
    assert R.load_class_params(spark, path, "threshold") is None
    R.save_class_params(table, path)
    assert R.load_class_params(spark, path, "threshold").first()["threshold"] == 0.3
    assert R.load_class_params(spark, path, "temperature") is None


def test_reports(spark, tmp_path):
    good = put(
        tmp_path / "good.json",
        '{"test": {"f1_macro": 0.42}, "n_samples": 2, "n_source_rows": 3,'
        ' "n_skipped_unmapped_labels": 1, "reference_type": "tool_predictions"}',
    )
    bad = put(tmp_path / "bad.json", "[1, 2]")
    found = R.read_metrics_json(spark, {"m": good, "bad": bad, "gone": str(tmp_path / "x.json")})
    assert {r["model"]: r["status"] for r in found.collect()} == {
        "m": "found", "bad": "invalid", "gone": "missing",
    }
    assert "2 of 3 demo" in R.benchmark_wording(found, "m").first()[0]
    assert "1 sequences were dropped" in R.benchmark_wording(found, "m").first()[0]
    assert "not run yet" in R.benchmark_wording(found, "gone").first()[0]
    assert R.class_markdown(found, "m", "per_class").isEmpty()
    assert [r["line"][-9:] for r in R.files_consumed(found).filter("model = 'gone'").collect()] == ["(missing)"]
    rows = found.select("model", F.lit("test").alias("split"), F.col("report.test")["f1_macro"].alias("f1_macro"))
    lines = [r["line"] for r in R.comparison_markdown(comparison_table([rows], ["m", "other"])).orderBy("line_no").collect()]
    assert "| m | 0.420 |" in lines[2] and "not available" in lines[3]


def test_text_before_the_first_mark_is_no_record(spark, tmp_path):
    put(tmp_path / "a.fasta", "a note\nof two lines\n>p1 first\nMSK\nGEE\n>p2\nAAA\n")
    put(tmp_path / "b.fasta", ">p3\nCCC\n")
    put(tmp_path / "c.fasta", "no record at all\n")
    put(tmp_path / "d.fasta", "")
    put(tmp_path / "e.fasta", "\n>p4 x\nDD\n")
    rows = X.read_fasta(spark, str(tmp_path / "*.fasta")).collect()
    assert sorted((r["id"], r["sequence"]) for r in rows) == [("p1", "MSKGEE"), ("p2", "AAA"), ("p3", "CCC"), ("p4", "DD")]


def test_comparison_falls_back_to_the_overall_block(spark):
    rows = spark.createDataFrame(
        [("a", "overall", 0.5), ("a", "val", 0.9), ("b", "test", 0.25), ("b", "overall", 0.75)],
        "model string, split string, f1_macro double",
    )
    table = {r["model"]: r["f1_macro"] for r in comparison_table([rows], ["a", "b", "c"]).collect()}
    assert table == {"a": "0.500", "b": "0.250", "c": "not available"}


def test_assembled_report(spark, tmp_path):
    metrics = '{"f1_macro": 0.4, "f1_micro": 0.5}'
    per_class = '{"Nucleus": {"precision": 0.1, "recall": 0.2, "f1": 0.3, "support": 4}, "Golgi": {"precision": null, "recall": 1, "f1": 0, "support": 1}}'
    paths = {
        "probe": put(tmp_path / "p.json", '{"test": %s, "test_per_class": %s}' % (metrics, per_class)),
        "trained": put(tmp_path / "t.json", '{"overall": %s, "per_class": %s}' % (metrics, per_class)),
        "external": put(tmp_path / "e.json", '{"overall": %s, "n_samples": 2, "n_source_rows": 3, "n_skipped_unmapped_labels": 1, "reference_type": "tool_predictions"}' % metrics),
        "trees": str(tmp_path / "gone.json"),
    }
    found = R.read_metrics_json(spark, paths)
    classes = {"trained": "per_class", "probe": "test_per_class", "trees": "test_per_class"}
    report = R.assembled_report(found, ["probe", "trees", "trained"], "external", classes)
    lines = [r["line"] for r in report.orderBy("line_no").collect()]
    assert lines[0] == "# Comparison report" and lines[4].startswith("| Model | f1_macro")
    assert lines[6].startswith("| probe | 0.400 | 0.500 | — |")
    assert lines[7] == "| trees | " + " | ".join(["not available"] * 6) + " |"
    assert lines[8].startswith("| trained | 0.400 |")
    start = lines.index("## External benchmark")
    assert lines[start + 2].startswith("Evaluated on 2 of 3 demo") and lines[start + 6].startswith("| external | 0.400 |")
    by_class = lines.index("## trained, by class")
    assert lines[by_class + 2].startswith("| Class |") and "| Golgi | — | 1.000 | 0.000 | 1 |" in lines[by_class:by_class + 7]
    assert "## probe, by class" in lines and "## trees, by class" not in lines
    assert lines[-5] == "## Files read" or "## Files read" in lines[-6:]
    R.write_report(report, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == lines
    # Without the benchmark a sentence says so, and no table follows.
    bare = [r["line"] for r in R.assembled_report(found, ["probe"], "trees", {}).orderBy("line_no").collect()]
    at = bare.index("## External benchmark")
    assert "not run yet" in bare[at + 2] and bare[at + 4] == "## Files read"


def test_embedding_store_reads_touched_ranges_and_survives_two_writers(spark, tmp_path):
    path, reads = str(tmp_path / "ranges"), []
    df = spark.createDataFrame([(i, "MSK" + "A" * i) for i in range(40)], "id int, sequence string")

    def encode(new):
        reads.append(new.count())
        return new.select("emb_key", F.array(F.length("sequence").cast("float")).alias("embedding"))

    out, n = St.embedding_store(df, encode, path, "k")
    assert n == 40 and {r["id"]: r["embedding"] for r in out.collect()} == {i: [3.0 + i] for i in range(40)}
    folders = {p.name for p in (tmp_path / "ranges").iterdir() if p.is_dir()}
    assert folders == {f"key_range={r['emb_key'][:2]}" for r in out.collect()}
    one = df.filter("id = 7")
    out, n = St.embedding_store(one, encode, path, "k")
    assert n == 0 and out.first()["embedding"] == [10.0] and reads == [40, 0]
    touched = out.first()["emb_key"][:2]
    plan = St.stored(spark, path, [touched])._jdf.queryExecution().toString()
    assert "PartitionFilters: [key_range" in plan or "PartitionFilters: [isnotnull(key_range" in plan
    # A second writer that stored the same key leaves one row a key.
    again = spark.read.parquet(path).filter(F.col("key_range") == touched).select("emb_key", "embedding", "key_range")
    again.cache().count()
    again.write.mode("append").partitionBy("key_range").parquet(path)
    out, n = St.embedding_store(one, encode, path, "k")
    assert (out.count(), n) == (1, 0)


def test_embedding_store_encodes_new_sequences_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "MSKM"), (2, "MSKM"), (3, "AAAA")], "id int, sequence string")
    encode = lambda new: E.kmer_embed(new, "emb_key", "sequence", 2, 8)
    out, n = St.embedding_store(df.filter("id < 3"), encode, path, "k2")
    assert (out.count(), n) == (2, 1)
    out, n = St.embedding_store(df, encode, path, "k2")
    assert (out.count(), n) == (3, 1)
    assert St.embedding_store(df, encode, path, "other")[1] == 2


def sequences(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice(["Nucleus", "Cytoplasm", "Membrane"])
        weight = {"Nucleus": "KR", "Cytoplasm": "ED", "Membrane": "LIV"}[label]
        text = "".join(rng.choice(weight * 3 + P.RESIDUES) for _ in range(rng.randint(40, 120)))
        rows.append((f"P{i}", text, f"SUBCELLULAR LOCATION: {label}.", i))
    return rows


def test_end_to_end(spark, tmp_path):
    raw = spark.createDataFrame(
        sequences(90), "Entry string, Sequence string, `Subcellular location [CC]` string, ord int"
    )
    processed = prepare(raw, ["ord"], min_samples=5)
    assert processed.columns == ["accession", "sequence", "locations", "locations_str"]
    assert processed.count() == 90
    splits = prepare_splits(processed, test=0.2, val=0.2)
    path = str(tmp_path / "splits")
    T.write_splits(splits, path)
    loaded = T.load_split(spark, path)
    assert loaded.count() == 90
    assert T.load_split(spark, path, "test").select("split").distinct().count() == 1
    labels = ["Cytoplasm", "Membrane", "Nucleus"]
    vectors = E.kmer_embed(loaded, "accession", "sequence", 1, 32)
    hot = F.array(*[F.array_contains("locations", x).cast("int") for x in labels])
    rows = loaded.join(vectors, "accession").select(
        F.col("accession").alias("id"),
        "sequence",
        F.col("embedding").cast("array<double>").alias("features"),
        hot.alias("y"),
        "split",
    ).persist()
    scorer = M.linear_probe(rows.filter("split = 'train'"), labels, c=100.0)
    scorer = M.calibrated_scorer(scorer, rows.filter("split = 'val'"))
    overall, per_class = M.evaluate(rows.filter("split = 'test'"), scorer, calibrated=True)
    assert overall.first()["f1_macro"] > 0.6 and per_class.count() == 3
    M.save_scorer(spark, scorer, str(tmp_path), "first")
    again = M.load_scorer(spark, str(tmp_path))
    a = M.score_batch(rows, scorer).select("id", "predictions").orderBy("id").collect()
    b = M.score_batch(rows, again).select("id", "predictions").orderBy("id").collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        M.load_scorer(spark, str(tmp_path / "nothing"))


def test_constant_class(spark):
    rows = spark.createDataFrame(
        [([float(i)], [1, 0, int(i > 2)]) for i in range(6)], "features array<double>, y array<int>"
    )
    for scorer in (M.linear_probe(rows, ["a", "b", "c"]), M.boosted_trees(rows, ["a", "b", "c"], 2, 2)):
        preds = [r["preds"] for r in M.decide(M.add_logits(rows, scorer), scorer).collect()]
        assert all(p[0] == 1 and p[1] == 0 for p in preds)


def test_stream_is_replay_safe_and_splits_rows(spark, tmp_path):
    rows = [("a", " mskgeelftgv "), ("b", "MSK"), ("c", "MSKGEELFT1"), ("d", "M" * 2049)]
    spark.createDataFrame(rows, "id string, sequence string").write.parquet(str(tmp_path / "in"))
    requests = S.read_requests(spark, str(tmp_path / "in"), "id string, sequence string")
    score = lambda df: df.withColumn("predictions", F.array(F.lit("x")))
    paths = [str(tmp_path / p) for p in ("ok", "bad", "ckpt")]
    for _ in range(2):
        S.score_stream(requests, score, *paths).awaitTermination()
    ok = spark.read.parquet(paths[0]).collect()
    assert [(r["id"], r["sequence"], r["sequence_length"], r["threshold"]) for r in ok] == [
        ("a", "MSKGEELFTGV", 11, 0.5)
    ]
    bad = spark.read.parquet(paths[1]).collect()
    assert {r["id"]: r["error"] for r in bad} == {
        "b": "too_short", "c": "invalid_residues", "d": "too_long_for_batch",
    }


def test_served_batches_keep_their_bundle(spark, tmp_path):
    import shutil

    from seqtables.plans.linear import LinearModel

    def scorer(label):
        return M.Scorer([label, "b"], [LinearModel(np.array([1.0]), 5.0), -9.0])

    def encode(df):
        return df.withColumn("features", F.array(F.length("sequence") / 1000))

    root, out, folder = (str(tmp_path / p) for p in ("bundles", "out", "in"))
    schema = "id string, sequence string"

    def send(i, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def serve(checkpoint="ckpt"):
        requests = S.read_requests(spark, folder, schema)
        S.serve_stream(requests, root, encode, out, str(tmp_path / checkpoint)).awaitTermination()
        ok, bad, commits = S.served(spark, out)
        found = {r["id"]: (r["predictions"][0]["location"], r["sequence_length"], r["threshold"]) for r in ok.collect()}
        return found, {r["id"]: r["error"] for r in bad.collect()}, commits.orderBy("batch").collect()

    first = M.save_scorer(spark, scorer("old"), root, "m")
    send(0, [("a", "mskgeelftgv"), ("b", "MSK")])
    assert serve()[0] == {"a": ("old", 11, 0.5)}
    # A bundle saved in between serves the next batch only.
    second = M.save_scorer(spark, scorer("new"), root, "m")
    send(1, [("c", "MSKGEELFTGVV"), ("d", "M" * 2049)])
    ok, bad, commits = serve()
    assert ok == {"a": ("old", 11, 0.5), "c": ("new", 12, 0.5)}
    assert bad == {"b": "too_short", "d": "too_long_for_batch"}
    assert [(r["batch"], r["bundle"], r["accepted"], r["rejected"]) for r in commits] == [(0, first, 1, 1), (1, second, 1, 1)]
    # A batch whose commit was lost is unseen, and replayed with the bundle it began with.
    shutil.rmtree(f"{out}/commits/batch=1")
    shutil.rmtree(f"{out}/rejected/batch=1")
    (tmp_path / "ckpt" / "commits" / "1").unlink()
    for crc in (tmp_path / "ckpt" / "commits").glob(".1.crc"):
        crc.unlink()
    M.save_scorer(spark, scorer("newest"), root, "m")
    assert {r["id"] for r in S.served(spark, out)[0].collect()} == {"a"}
    assert serve()[:2] == (ok, bad)


def test_stored_sequences_are_cut_and_keys_are_whole(spark, tmp_path):
    seen = []

    def encode(new):
        seen.extend(r["sequence"] for r in new.collect())
        return new.select("emb_key", F.array(F.lit(1.0)).alias("embedding"))

    df = spark.createDataFrame([(1, "A" * 50)], "id int, sequence string")
    out, _ = St.embedding_store(df, encode, str(tmp_path / "cut"), "k", max_length=8)
    assert seen == ["A" * 8] and len(out.first()["emb_key"]) == 64


def test_repeated_tool_lines_keep_the_last(spark, tmp_path):
    path = tmp_path / "sp.txt"
    path.write_text("# c\nseq_0\tOTHER\t0.1\nseq_1\tSP\t0.9\nseq_0\tSP\t0.8\n")
    rows = {r["id"]: (r["has_sp"], r["sp_prob"]) for r in X.read_signal_peptide_results(spark, str(path)).collect()}
    assert rows == {"seq_0": (1.0, 0.8), "seq_1": (1.0, 0.9)}
    path = tmp_path / "tm.txt"
    path.write_text("seq_0 len=10 ExpAA=5.0 PredHel=1\nseq_0 len=10 ExpAA=0.0 PredHel=0\n")
    rows = X.read_tm_results(spark, str(path)).collect()
    assert [(r["id"], r["n_helices"], r["tm_fraction"]) for r in rows] == [("seq_0", 0.0, 0.0)]


def test_pages_are_matched_by_name(spark, tmp_path):
    a, b = tmp_path / "a.tsv", tmp_path / "b.tsv"
    a.write_text("Entry\tSequence\nP1\tMSK\n")
    b.write_text("Sequence\tEntry\nAAA\tP2\n")
    rows = T.read_raw(spark, [str(a), str(b)]).collect()
    assert sorted((r["Entry"], r["Sequence"]) for r in rows) == [("P1", "MSK"), ("P2", "AAA")]
    with pytest.raises(Exception, match="header"):
        T.read_raw(spark, str(tmp_path / "*.tsv")).collect()


def test_boosted_trees_query_fits_the_default_model(spark, sf, monkeypatch):
    import inspect

    from seqtables import catalog
    from seqtables.catalog import learning

    original, asked = learning.M.boosted_trees, []

    def small(train, labels, **given):
        asked.append(inspect.signature(original).bind(train, labels, **given))
        return original(train, labels, n_trees=1, depth=1)

    monkeypatch.setattr(learning.M, "boosted_trees", small)
    assert catalog.queries()["boosted_trees"](spark, sf).count() == 3
    asked[0].apply_defaults()
    assert asked[0].arguments["n_trees"] == 300 and asked[0].arguments["depth"] == 6
