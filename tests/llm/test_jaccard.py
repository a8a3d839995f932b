"""The Jaccard join against all pairs in plain Python, with small tiles forced."""

import random
import re

import numpy as np
import pytest

from seqtables.llm import jaccard
from seqtables.llm.jaccard import (
    Bands,
    Mapped,
    jaccard_components,
    level_bitmaps,
    parity_bitmap,
    run_forest,
    signatures,
)


def shingles(text, width):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return set()
    size = min(width, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), sets[i][0]), sets[i][0])
    return sorted((sets[i][0], len(sets[i][1]), least[find(i)]) for i in range(len(rows)))


def corpus(seed, n=150):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(20)]
    rows, texts = [], []
    for i in range(n):
        if texts and draw.random() < 0.7:
            words = list(draw.choice(texts[-12:]))
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 8, 30, 80, 200]))]
            if draw.random() < 0.5:
                words += passage
        texts.append(words)
        rows.append((1000 - i, " ".join(words)))
    return rows


def found(spark, docs, rows, width, percent):
    out = jaccard_components(docs(rows), "doc_id", "text", width, percent).collect()
    return sorted((r["row_id"], r["n_shingles"], r["component_id"]) for r in out)


@pytest.mark.parametrize("width,percent,block", [(3, 90, 512), (5, 80, 512), (3, 90, 4), (2, 70, 5)])
def test_matches_all_pairs(spark, docs, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = corpus(width + percent)
    assert found(spark, docs, rows, width, percent) == brute(rows, width, percent)


def test_edges(spark, docs):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a"), (7, long), (8, long + " end"),
        (9, "x y z"), (9, "x y z"), (10, "x y z"), (11, "É x"), (12, "é x"),
    ]
    assert found(spark, docs, rows, 3, 90) == brute(rows, 3, 90)
    assert jaccard_components(docs([]), "doc_id", "text").count() == 0
    null = jaccard_components(docs([(None, "p q r"), (3, "p q r"), (None, "other words here")]), "doc_id", "text")
    rows = sorted(map(repr, ((r["row_id"], r["component_id"]) for r in null.collect())))
    assert rows == ["(3, 3)", "(None, 3)", "(None, None)"]


def test_bands_and_segments_lose_no_pair():
    draw = np.random.default_rng(6)
    for percent in (70, 80, 90, 95):
        for _ in range(120):
            n = int(draw.integers(1, 300))
            a = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
            keep = draw.uniform(size=len(a)) < draw.choice([0.85, 0.95, 1.0])
            b = np.unique(np.concatenate((a[keep], draw.integers(0, 2**64, int(draw.integers(0, 12)), dtype=np.uint64))))
            if len(b) == 0 or len(a) == len(b) == len(np.intersect1d(a, b)):
                continue
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= percent * (len(a) + len(b) - both)
            shared = np.intersect1d(signatures(a, Bands(percent)), signatures(b, Bands(percent)))
            assert len(shared) or not linked
            differ = int(np.bitwise_count(parity_bitmap(a) ^ parity_bitmap(b)).sum())
            assert both <= (len(a) + len(b) - differ) // 2


def mapped(sets, percent):
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return Mapped.read(sizes, b"".join(level_bitmaps(s, percent) for s in sets), percent)


def drawn(draw, n):
    return np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_bitmaps_of_long_sets_pass_linked_pairs_only(percent):
    draw = np.random.default_rng(percent)
    for n in (900, 1023, 1024, 1100, 1279, 2047, 2048, 2500, 5000, 9000):
        a = drawn(draw, n)
        swapped = n * (100 - percent) // (100 + percent)
        linked = [
            a[: -(-n * percent // 100)],
            np.unique(np.concatenate((a, drawn(draw, n * 100 // percent - n)))),
            np.unique(np.concatenate((a[swapped:], drawn(draw, swapped)))),
        ]
        apart = [drawn(draw, n), np.unique(np.concatenate((a[: n // 10], drawn(draw, n - n // 10))))]
        seen = mapped([a, *linked, *apart], percent).may_link(0, np.arange(1, 6), percent)
        assert seen[:3].all()
        assert percent < 80 or not seen[3:].any()


def test_long_sets_of_a_common_passage_form_no_group():
    draw = np.random.default_rng(2)
    passage = drawn(draw, 100)
    sets = [np.unique(np.concatenate((passage, drawn(draw, 4000 + 40 * i)))) for i in range(30)]
    sets.append(sets[3][:-200])
    assert run_forest(np.arange(31), mapped(sets, 80), 80) == [(3, 30)]


def test_components_match_union_find(spark):
    from seqtables.llm.components import components

    draw = random.Random(8)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    loose = [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)]
    pairs = chain + star + loose
    draw.shuffle(pairs)
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(pairs, "a long, b long")
    found = {r["id"]: r["root"] for r in components(frame, "a", "b").collect()}
    assert found == {x: find(x) for x in root if find(x) != x}


def test_other_ids_than_integers_are_refused(spark):
    rows = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    with pytest.raises(TypeError, match="integers"):
        jaccard_components(rows, "doc_id", "text")


def test_words_alike_but_for_swapped_letters_do_not_link(spark, docs):
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < 1024:
        word += word.translate(swap)
    rows = [(1, word), (2, word.translate(swap)), (3, word)]
    assert found(spark, docs, rows, 3, 90) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
