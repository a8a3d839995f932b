"""Column functions on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions import annotations as A
from seqtables.functions import features as X
from seqtables.functions import keys as K
from seqtables.functions import properties as B
from seqtables.functions import scores as S
from seqtables.functions import sequences as Q

GFP = "MSKGEELFTGVVPILVELDGDVNGHK"


def one(spark, expr, *values, kinds=None):
    schema = kinds or ", ".join(f"v{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SUBCELLULAR LOCATION: Nucleus. Cytoplasm.", ["Nucleus", "Cytoplasm"]),
        ("SUBCELLULAR LOCATION: Nucleus {ECO:0000269|PubMed:12345}", ["Nucleus"]),
        ("SUBCELLULAR LOCATION: Cell membrane; Peripheral membrane protein", ["Cell membrane"]),
        ("SUBCELLULAR LOCATION: Membrane; Single-pass type I membrane protein", ["Membrane"]),
        ("SUBCELLULAR LOCATION: Cytoplasm. Note=Also found in nucleus.", ["Cytoplasm"]),
        ("", []),
        (None, []),
    ],
)
def test_parse_annotations(spark, text, expected):
    assert one(spark, A.parse_annotations(F.col("v0")), text) == expected


@pytest.mark.parametrize(
    "labels, expected",
    [
        (["Nucleolus"], ["Nucleus"]),
        (["MITOCHONDRION"], ["Mitochondrion"]),
        (["Unknown organelle"], []),
        (["Cytoplasm", "Cytosol"], ["Cytoplasm"]),
        (["Golgi apparatus membrane", "Secreted"], ["Golgi Apparatus", "Secreted/Extracellular"]),
        ([], []),
    ],
)
def test_map_to_groups(spark, labels, expected):
    assert one(spark, A.map_to_groups(F.col("v0")), labels, kinds="v0 array<string>") == expected


def test_label_strings(spark):
    assert one(spark, A.string_to_labels(F.col("v0")), "Nucleus|Cytoplasm") == ["Nucleus", "Cytoplasm"]
    assert one(spark, A.string_to_labels(F.col("v0")), None) == []
    hot = A.multi_hot(F.col("v0"), ["Cytoplasm", "Membrane", "Nucleus"])
    assert one(spark, hot, ["Nucleus", "Cytoplasm", "Other"], kinds="v0 array<string>") == [1, 0, 1]


def test_external_labels(spark):
    text = " extracellular |Endoplasmic reticulum||EXTRACELLULAR|Plastid"
    assert one(spark, A.map_external_labels(F.col("v0")), text) == [
        "Secreted/Extracellular",
        "Endoplasmic Reticulum",
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("sp|P07221|CASQ1", ["sp|P07221|CASQ1", "P07221"]),
        ("P07221", ["P07221"]),
        ("a|b", ["a|b"]),
        ("a||c", ["a||c"]),
    ],
)
def test_aliases(spark, text, expected):
    assert one(spark, A.record_id_aliases(F.col("v0")), text) == expected


@pytest.mark.parametrize(
    "text, expected", [("9606", "Homo sapiens"), ("4932", "organism_4932"), ("yeast", "yeast")]
)
def test_organism_name(spark, text, expected):
    assert one(spark, A.organism_name(F.col("v0")), text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("M" * 30, True),
        ("MSK", False),
        ("M" * 2048, True),
        ("M" * 2049, False),
        ("m" * 30, True),
        ("M" * 29 + "X", True),
        ("M" * 29 + "U", True),
        ("M" * 29 + "1", False),
        ("", False),
        (None, False),
    ],
)
def test_valid_sequence(spark, text, expected):
    assert one(spark, Q.is_valid_sequence(F.col("v0")), text) is expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("  mskgeelftgv \n", None),
        ("MSK", "too_short"),
        ("MSKGEELFT1", "invalid_residues"),
        ("M" * 5001, "too_long"),
        ("M" * 2049, "too_long_for_batch"),
        (None, "missing"),
    ],
)
def test_request_error(spark, text, expected):
    assert one(spark, Q.request_error(F.col("v0")), text) == expected


def test_clean_sequence(spark):
    assert one(spark, Q.clean_sequence(F.col("v0")), "MSKXUGEEL") == "MSKGEEL"
    assert one(spark, Q.clean_sequence(F.col("v0")), "mskgeel") == "MSKGEEL"


@pytest.mark.parametrize(
    "text, window, overlap, shortest, expected",
    [
        ("A" * 100, 200, 50, None, 1),
        ("A" * 200, 200, 50, None, 1),
        ("A" * 300, 100, 0, None, 3),
        ("A" * 105, 100, 0, 10, 1),
        ("A" * 105, 100, 0, 5, 2),
    ],
)
def test_chunk_count(spark, text, window, overlap, shortest, expected):
    chunks = one(spark, Q.chunk_sequence(F.col("v0"), window, overlap, shortest), text)
    assert len(chunks) == expected


def test_chunks_of_the_alphabet(spark):
    found = one(spark, Q.chunk_sequence(F.col("v0"), 10, 2), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    assert found == ["ABCDEFGHIJ", "IJKLMNOPQR", "QRSTUVWXYZ"]


@pytest.mark.parametrize("window, overlap", [(0, 0), (10, 10), (10, -1)])
def test_chunk_arguments(window, overlap):
    with pytest.raises(ValueError):
        Q.chunk_sequence(F.col("v0"), window, overlap)


def properties(spark, text, names, weights=None):
    df = spark.createDataFrame([(text,)], "sequence string")
    return B.sequence_properties(df, "sequence", names, weights).first()


def test_properties(spark):
    row = properties(
        spark, GFP, ["molecular_weight", "gravy", "isoelectric_point", "sequence_length", "other"]
    )
    mass = sum(P.RESIDUE_MASS[a] for a in GFP) - (len(GFP) - 1) * P.WATER_MASS
    assert row["molecular_weight"] == pytest.approx(mass)
    assert row["gravy"] == pytest.approx(sum(P.HYDROPATHY[a] for a in GFP) / len(GFP))
    assert 4 < row["isoelectric_point"] < 5
    assert row["sequence_length"] == 26
    assert math.isnan(row["other"])
    assert math.isnan(properties(spark, "MSK", ["gravy"])["gravy"])


def test_net_charge_is_zero_at_the_isoelectric_point(spark):
    df = spark.createDataFrame([(GFP,)], "sequence string")
    point = properties(spark, GFP, ["isoelectric_point"])[1]
    charge = B.with_residue_counts(df).select(B.net_charge(B.charge_groups(), F.lit(point)))
    assert abs(charge.first()[0]) < 1e-2


def test_instability(spark):
    weights = {"MS": 2.0, "SK": -1.0}
    row = properties(spark, "MSKGE", ["instability_index"], weights)
    assert row["instability_index"] == pytest.approx(10 / 5 * (2.0 - 1.0 + 1.0 + 1.0))
    with pytest.raises(ValueError):
        properties(spark, GFP, ["instability_index"])


@pytest.mark.parametrize(
    "text, signal, membrane",
    [
        ("M" + "L" * 30 + "S" * 50, 1.0, 1.0),
        ("M" + "K" * 30 + "S" * 50, 0.0, 0.0),
        ("S" * 50 + "I" * 25 + "S" * 50, 0.0, 1.0),
        ("M" + "S" * 100, 0.0, 0.0),
        ("", 0.0, 0.0),
        ("MSK", 0.0, 0.0),
        (None, 0.0, 0.0),
    ],
)
def test_aux_targets(spark, text, signal, membrane):
    df = spark.createDataFrame([(text,)], "s string")
    assert tuple(df.select(*B.aux_targets(F.col("s"))).first()) == (signal, membrane)


def test_python_extractor(spark):
    df = spark.createDataFrame([("MSK",), ("MMMM",)], "s string")
    extractors = {"signal_peptide": B.python_extractor(lambda t: t.count("M") / len(t))}
    rows = df.select(*B.aux_targets(F.col("s"), extractors)).collect()
    assert [tuple(r) for r in rows] == [(pytest.approx(1 / 3), 0.0), (1.0, 0.0)]


@pytest.mark.parametrize(
    "enabled, properties_, width",
    [
        ({"biophysical": True, "signal_peptide": True, "transmembrane": True}, ["gravy"], 6),
        ({"biophysical": True, "signal_peptide": True, "transmembrane": True}, ["a", "b", "c"], 8),
        ({"signal_peptide": True}, ["gravy"], 2),
        ({}, ["gravy"], 0),
    ],
)
def test_feature_width(enabled, properties_, width):
    assert X.feature_dim(enabled, properties_) == width


def test_feature_order(spark):
    enabled = {"biophysical": True, "signal_peptide": True, "transmembrane": True}
    df = spark.createDataFrame(
        [(0.5, 1.0, 0.9, 2.0, 1.0, None)],
        "gravy double, has_sp double, sp_prob double, n_helices double, has_tm double, tm_fraction double",
    )
    assert df.select(X.concat_features(enabled, ["gravy"])).first()[0] == [0.5, 1.0, 0.9, 2.0, 1.0, 0.0]


def ranked(spark, probs, labels, threshold, top_k):
    expr = S.rank_predictions(F.col("p"), F.col("l"), threshold, top_k)
    rows = spark.createDataFrame([(probs, labels)], "p array<double>, l array<string>")
    return [tuple(r) for r in rows.select(expr).first()[0]]


def test_rank_predictions(spark):
    two = ["Nucleus", "Cytoplasm"]
    probs = [1 / (1 + math.exp(1.0)), 1 / (1 + math.exp(0.4))]
    assert ranked(spark, probs, two, 0.0, 2) == [("Cytoplasm", 0.4013), ("Nucleus", 0.2689)]
    assert ranked(spark, [0.8, 0.25], two, S.double_array([0.95, 0.2]), 3) == [("Cytoplasm", 0.25)]
    assert ranked(spark, [0.1, 0.15], two, 0.5, 3) == [("Cytoplasm", 0.15)]
    assert ranked(spark, [0.7, 0.7, 0.9], ["b", "a", "c"], 0.5, 2) == [("c", 0.9), ("b", 0.7)]


def test_probabilities(spark):
    df = spark.createDataFrame([([0.0, 2.0],)], "z array<double>")
    assert df.select(S.probabilities(F.col("z"))).first()[0] == [0.5, pytest.approx(0.880797)]
    scaled = S.probabilities(F.col("z"), S.double_array([1.0, 2.0]))
    assert df.select(scaled).first()[0][1] == pytest.approx(0.731059)
    with pytest.raises(Exception, match="differ in length"):
        df.select(S.probabilities(F.col("z"), S.double_array([1.0]))).collect()


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(2, None), (1, "y")], "i int, s string")
    marks = [K.content_fingerprint(d).first() for d in (a, b, c)]
    assert marks[0] == marks[1] != marks[2]
    pair = [spark.createDataFrame([r], "a string, b string") for r in (("a|b", "c"), ("a", "b|c"), (None, ""), ("-", ""))]
    assert len({K.content_fingerprint(d).first()["content_hash"] for d in pair}) == 4
    many = spark.range(3).select(F.lit("x").alias("a"))
    one = K.content_fingerprint(many.limit(1)).first()["content_hash"]
    assert K.content_fingerprint(many).first()["content_hash"] == "-".join(str(3 * int(x)) for x in one.split("-"))
    same = [
        spark.range(1).select(K.params_fingerprint(p)).first()[0]
        for p in ({"a": 1, "b": 2, "root": "/x"}, {"b": 2, "a": 1, "root": "/y"})
    ]
    assert same[0] == same[1]


def test_trailing_newline_is_no_residue(spark):
    df = spark.createDataFrame([("M" * 30,), ("M" * 30 + "\n",), ("",), (None,)], "s string")
    from seqtables.functions.sequences import is_valid_sequence

    found = [r[0] for r in df.select(is_valid_sequence(F.col("s"))).collect()]
    assert found == [True, False, False, False]


def test_nan_scores_are_negative(spark):
    df = spark.createDataFrame([([0.7, float("nan"), 0.5],)], "p array<double>")
    assert df.select(S.binarize(F.col("p"))).first()[0] == [1, 0, 1]
    assert df.select(S.binarize(F.col("p"), S.double_array([0.8, 0.1, 0.5]))).first()[0] == [0, 0, 1]
