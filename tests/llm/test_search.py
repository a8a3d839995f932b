"""Ranked search against scores of all pairs, with ties, odd rows and several chunks of items."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from seqtables.llm import search
from seqtables.llm.search import DualTree, halved_order, impacts, item_trees, ranked_search, weights

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def all_scores(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) & c.keys()
            )
            if score > 0:
                found.append((-score, doc is None, doc))
        ranked = enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in ranked]
    return sorted(out, key=str)


@pytest.fixture
def tables(spark):
    def make(docs, items):
        d = [(i, t, 1, "x", 2) for i, t in docs]
        q = [(i, t, 5, "y") for i, t in items]
        return (
            spark.createDataFrame(d, "doc_id long, text string, n int, rank string, score int"),
            spark.createDataFrame(q, "item_id long, text string, _item int, chunk string"),
        )

    return make


def found(docs, items, **limits):
    rows = ranked_search(docs, items, "doc_id", "text", **limits).collect()
    return sorted(((r["item"], r["rank"], r["row_id"], r["score"]) for r in rows), key=str)


def drawn(seed, n_docs, n_items):
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]

    def text(size):
        return " ".join(words[min(int(x), 299)] for x in draw.exponential(40, size))

    docs = [(int(i), text(int(draw.integers(1, 120)))) for i in draw.permutation(n_docs)]
    docs += [(i + n_docs, t) for i, t in docs[:25]]
    return docs, [(i, text(int(draw.integers(1, 25)))) for i in range(n_items)]


@pytest.mark.parametrize("limits", [{}, {"most": 300}, {"k": 3}])
def test_drawn_texts(tables, limits):
    docs, items = drawn(3, 400, 30)
    expected = all_scores(docs, items, limits.get("k", 10))
    assert found(*tables(docs, items), **limits) == expected


def test_odd_rows(tables):
    docs = [
        (1, None), (2, ""), (3, "... \t"), (4, "Alpha beta"), (4, "Alpha beta"), (5, "ALPHA, beta!"),
        (None, "alpha beta"), (6, "Ärger zwei alpha2"), (7, "gamma " * 3_000), (8, "beta\x00delta"),
    ]
    items = [
        (1, "alpha"), (1, "alpha"), (None, "beta alpha"), (3, None), (4, "--"), (5, "none of these"),
        (6, "Ärger zwei"), (7, "gamma delta"),
    ]
    got = found(*tables(docs, items))
    assert got == all_scores(docs, items)
    # Equal scores go by id, the null id last; a repeated row has its own place.
    assert [(r, d) for i, r, d, _ in got if i is None] == [(1, 4), (2, 4), (3, 5), (4, None), (5, 8)]
    assert [g[2] for g in got if g[0] == 6] == [6]


def test_ties_beyond_k(tables):
    docs = [(i, "one two three") for i in range(200, 0, -1)] + [(0, "four five six seven")]
    assert found(*tables(docs, [(1, "two"), (2, "four")])) == all_scores(docs, [(1, "two"), (2, "four")])


def test_empty_tables(tables):
    docs, items = drawn(1, 5, 2)
    assert found(*tables([], items)) == [] and found(*tables(docs, [])) == []
    assert found(*tables([(1, None)], items)) == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "name string, body string")
    items = spark.createDataFrame([("q", "X")], "item string, words string")
    rows = ranked_search(docs, items, "name", "body", "item", "words").collect()
    assert [(r["item"], r["rank"], r["row_id"]) for r in sorted(rows)] == [("q", 1, "a"), ("q", 2, "b")]


@pytest.mark.parametrize("exact", [search.EXACT, 1])
def test_batches_are_pruned_without_loss(monkeypatch, exact):
    """Two vocabularies: blocks of one have no bound for items of the other."""
    monkeypatch.setattr(search, "EXACT", exact)
    draw = np.random.default_rng(7)
    half = draw.integers(0, 2, 3_000)
    term = [np.unique(draw.integers(0, 400, 40)) + 400 * h for h in half]
    owner = np.repeat(np.arange(3_000), [len(t) for t in term])
    term = np.concatenate(term)
    tf = draw.integers(1, 9, len(term))
    n = np.bincount(owner, tf).astype(np.int64)
    impact = impacts(tf, n[owner], 3_000, int(n.sum()))
    weight = weights(np.bincount(term, minlength=800), 3_000)
    asked = [np.unique(draw.integers(0, 400, 12)) + 400 * (i % 2) for i in range(40)]
    pairs = np.array([(i, t) for i, ts in enumerate(asked) for t in ts]).T
    tree = DualTree(item_trees(*pairs, weight), weight, 40, np.zeros(40, np.int64), 10)
    for lo in range(0, 3_000, 1_000):
        mine = (owner >= lo) & (owner < lo + 1_000)
        tree.block(owner[mine] - lo, term[mine], impact[mine], list(range(lo, lo + 1_000)))
    dense = np.zeros((3_000, 800), np.int64)
    dense[owner, term] = impact
    for i, ts in enumerate(asked):
        scores = dense[:, ts] @ weight[ts]
        best = np.lexsort((np.arange(3_000), -scores))[:10]
        assert [(-s, r) for s, _, r in tree.best.rows[i]] == [(scores[b], b) for b in best]
    assert tree.best.scored < 0.5 * tree.best.pairs


def test_order_is_a_permutation():
    draw = np.random.default_rng(2)
    owner, term = np.sort(draw.integers(0, 37, 200)), draw.integers(0, 9, 200)
    assert sorted(halved_order(owner, term, draw.random(200), 37, 4).tolist()) == list(range(37))
    none = np.empty(0, np.int64)
    assert halved_order(none, none, none, 3, 1).tolist() == [0, 1, 2]
