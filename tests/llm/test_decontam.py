"""Decontamination against a search for every window in every document."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from seqtables.llm import catalog
from seqtables.llm.decontam import SuffixAutomaton, clean_documents, find_spans, hit_digests, item_words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lowered)


def brute(items, text, window=10):
    mine, hit, names = words(text), set(), set()
    for name, other in items:
        other = words(other)
        size = min(window, len(other))
        windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else ()
        for i in range(len(mine) - size + 1):
            if tuple(mine[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return [len(mine), len(hit), len(names), digest, bool(hit)]


def found(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = hit_digests(find_spans(docs, bench, "doc_id", "text", **options)).collect()
    return {r["row_id"]: list(r)[1:] for r in rows}


def test_query_matches_brute_force(spark, sf, duck, documents):
    items = duck.sql("select item_id, text from benchmark").fetchall()
    rows = catalog.queries()["op5_decontaminate"](spark, sf).collect()
    assert any(r["contaminated"] for r in rows)
    for r in rows[::3]:
        assert list(r)[1:] == brute(items, documents[r["doc_id"]])


def test_short_items_overlaps_repeats_and_chunks(spark, docs):
    a = " ".join(f"w{i}" for i in range(14))
    items = [(1, a), (2, "short one"), (3, None), (4, "..."), (5, "a b a b a b a b a b a b"), (1, a), (6, "one")]
    texts = {
        1: "x " + a + " y",
        2: "Short, ONE! and " + " ".join(a.split()[2:12]),
        3: None,
        4: "",
        5: "b a b a b a b a b a b a b",
        6: " ".join(a.split()[:9]),
        7: a + " " + a + " é short one short one",
        8: ("z " * 40_000) + a,
    }
    rows = docs(list(texts.items()))
    want = {k: brute(items, t) for k, t in texts.items()}
    assert found(spark, rows, items) == want
    assert found(spark, rows, items, most=20) == want
    assert found(spark, rows, []) == {k: brute([], t) for k, t in texts.items()}
    assert found(spark, docs([]), items) == {}


def test_longest_matches_of_random_strings():
    import random

    draw = random.Random(3)
    items = [(str(i), [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 12))]) for i in range(30)]
    automaton = SuffixAutomaton(items, window=4)
    for _ in range(200):
        text = [draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        spans, names = automaton.scan(text)
        joined = [(n, " ".join(w.decode() for w in ws)) for n, ws in items]
        want = brute(joined, " ".join(w.decode() for w in text), window=4)
        covered = {i for a, b in spans for i in range(a, b + 1)}
        assert [len(covered), len(names)] == want[1:3]


def test_cleaning_cuts_spans_and_drops_covered_documents(spark, docs):
    a = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(20))
    rows = docs([(1, f"{filler} {a}, tail"), (2, a), (3, None), (4, ""), (None, filler), (6, filler)])
    out = clean_documents(rows, bench)
    assert out.columns == rows.columns
    kept = sorted((repr(r["doc_id"]), r["text"]) for r in out.collect() if r["text"] is not None)
    assert kept == [("1", f"{filler} , tail"), ("4", ""), ("6", filler), ("None", filler)]
    assert out.filter(F.col("doc_id") == 3).count() == 1


def test_chunks_do_not_change_the_result(spark, docs):
    def run(letter, n, first=0):
        return " ".join(f"{letter}{i}" for i in range(first, first + n))

    # Item 3 overlaps the end of item 1 by four words; each item is a chunk of its own.
    items = [(1, run("a", 12)), (2, run("b", 12)), (3, run("a", 14, first=8)), (4, "p q r s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        (1, f"{run('a', 12)} {run('x', 16)} {run('b', 12)}"),
        (2, f"{run('x', 60)} {run('a', 22)} {run('y', 9)}"),
        (3, f"{run('x', 30)} p q {run('a', 12)} r s {run('y', 9)}"),
        (4, run("x", 20)),
        (5, None),
        (4, run("x", 20)),
        (None, f"{run('x', 30)}, {run('b', 12)}!"),
        (6, ""),
    ]
    rows = docs(texts)

    def cleaned(most):
        out = clean_documents(rows, bench, most=most)
        assert out.schema == rows.schema
        return sorted(repr(tuple(r)) for r in out.collect())

    one = cleaned(10_000)
    assert not any(r.startswith("(1,") for r in one) and len(one) == 7
    assert any(f"{run('x', 60)}  {run('y', 9)}" in r for r in one)
    assert any(f"p q  r s {run('y', 9)}" in r for r in one)
    assert cleaned(1) == one

    def spans(most):
        return sorted(map(repr, find_spans(rows, bench, "doc_id", "text", most=most).collect()))

    assert len(spans(1)) == len(texts)
    assert spans(1) == spans(10_000)


def test_words_are_those_of_the_contract():
    text = "Ab-c9 É x_Y\x7fz\u0080"
    assert [w.decode() for w in item_words(text)] == words(text)


@pytest.mark.parametrize("most", [1, 10_000])
def test_columns_named_like_helpers_are_kept(spark, most):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "p q r")], "item_id long, text string")
    rows = spark.createDataFrame(
        [(777, "h", "z " * 30 + "p q r", 4, "d"), (5, None, "plain text", None, "e")],
        "_row long, _hits string, text string, row int, hits string",
    )
    out = clean_documents(rows, bench, most=most)
    assert out.schema == rows.schema
    kept = sorted(out.collect(), key=lambda r: r["_row"])
    assert [(r["_row"], r["_hits"], r["row"], r["hits"]) for r in kept] == [(5, None, None, "e"), (777, "h", 4, "d")]
    assert kept[1]["text"].strip() == ("z " * 30).strip()


@pytest.mark.parametrize("most", [1, 10_000])
def test_ids_keep_their_type(spark, most):
    bench = spark.createDataFrame([(1, "p q r"), (2, "u v w")], "item_id long, text string")
    rows = spark.createDataFrame([("k-1", "x p q r"), ("k-2", "y")], "id string, text string")
    out = hit_digests(find_spans(rows, bench, "id", "text", most=most)).collect()
    assert sorted((r["row_id"], r["n_hit"]) for r in out) == [("k-1", 3), ("k-2", 0)]
