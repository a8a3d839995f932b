"""Fingerprints: syncmers by definition, edited texts by hand, likeness and neighbours."""

import hashlib

import numpy as np
import pytest

from seqtables.llm import catalog
from seqtables.llm.syncmers import (
    anchors,
    chain,
    closed_syncmers,
    fingerprint_edits,
    likeness,
    rolling,
    with_next,
)


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in catalog.queries()["op8_fingerprint"](spark, sf).collect()}
    order = sorted(documents)
    assert sorted(rows) == order
    by_text = {}
    for i, doc in enumerate(order):
        text, after = documents[doc], documents[order[(i + 1) % len(order)]]
        r = rows[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited(text, after).encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    apart = [rows[d]["near_edited"] > rows[d]["near_next"] for d in order if documents[d]]
    assert np.mean(apart) > 0.95


def test_closed_syncmers_by_definition():
    codes = np.random.default_rng(1).integers(97, 101, 300).astype(np.uint64)
    k, s = 9, 4
    inner = rolling(codes, s)
    want = []
    for i in range(len(codes) - k + 1):
        window = inner[i : i + k - s + 1]
        if window.min() in (window[0], window[-1]):
            want.append(i)
    at, found = closed_syncmers(codes, k, s)
    assert at.tolist() == want
    whole = rolling(codes, k)
    assert (found == whole[want]).all()
    assert len({tuple(codes[i : i + k]) for i in range(250)}) == len(set(whole[:250].tolist()))


def test_anchors_do_not_depend_on_context():
    draw = np.random.default_rng(2)
    text = "".join(map(chr, draw.integers(97, 123, 5_000)))
    moved = anchors("zz" + text, size=10_000)
    here = anchors(text, size=10_000)
    assert set(here[0]) <= set(moved[0])
    assert dict(zip(*moved))[here[0][0]] == here[1][0] + 2


def test_likeness_and_chain():
    draw = np.random.default_rng(3)
    text = "".join(map(chr, draw.integers(97, 123, 4_000)))
    other = "".join(map(chr, draw.integers(97, 123, 4_000)))
    a = anchors(text)
    assert likeness(a, a) == 1.0
    assert likeness(a, anchors(other)) < 0.05
    assert 0.2 < likeness(a, anchors(text[:2_000] + other[:2_000])) < 0.5
    blocks = [text[i : i + 400] for i in range(0, 4_000, 400)]
    assert likeness(a, anchors("".join(reversed(blocks)))) < 0.4
    assert likeness(anchors(""), anchors("")) == 1.0 and likeness(anchors(""), a) == 0.0
    assert chain(np.array([3, 1, 2, 5, 4, 6])) == 4
    repeated = anchors("ab" * 400_000 + text)
    assert len(repeated[0]) == 64 and repeated[1].max() < 804_000


def test_only_empty_texts_have_the_empty_fingerprint():
    draw = np.random.default_rng(4)
    bare = []
    for n in [*range(1, 20)] * 40:
        text = "".join(map(chr, draw.integers(97, 123, n)))
        mark = anchors(text)
        assert len(mark[0]) >= 1 and likeness(mark, mark) == 1.0
        codes = np.array([ord(c) for c in text], np.uint64)
        if n >= 12 and len(closed_syncmers(codes)[0]) == 0:
            bare.append(text)
    assert len(bare) > 20 and max(map(len, bare)) <= 16
    marks = [anchors(t) for t in bare]
    assert all(likeness(a, b) == 0.0 for a, b in zip(marks, marks[1:]))
    assert len({int(m[0][0]) for m in marks}) == len(set(bare))
    assert len(anchors("")[0]) == 0


def test_edges(spark, docs):
    texts = [(5, "last text here"), (1, None), (2, ""), (3, "é\U0001f600漢 four"), (9, "x" * 200_000), (3, "é\U0001f600漢 four")]
    rows = fingerprint_edits(docs(texts), "doc_id", "text").collect()
    assert len(rows) == len(texts)
    order = sorted(texts, key=lambda x: (x[0], x[1] or ""))
    want = sorted(
        (k, len(t or ""), hashlib.sha256(edited(t or "", order[(i + 1) % 6][1] or "").encode()).hexdigest())
        for i, (k, t) in enumerate(order)
    )
    assert sorted((r["key"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert fingerprint_edits(docs([]), "doc_id", "text").count() == 0
    alone = fingerprint_edits(docs([(7, "only")]), "doc_id", "text").collect()
    assert [r["near_next"] for r in alone] == [1.0]


def test_next_rows_with_null_keys(spark, docs):
    rows = docs([(None, "n"), *[(i, str(i)) for i in range(50, 0, -1)]])
    found = {r["text"]: r["next_text"] for r in with_next(rows, "doc_id", "text").collect()}
    assert found == {"n": "1", **{str(i): str(i + 1) for i in range(1, 50)}, "50": "n"}


def test_other_keys_than_integers_are_refused(spark):
    rows = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    with pytest.raises(TypeError, match="integers"):
        fingerprint_edits(rows, "doc_id", "text")
