"""Periodic runs against a search of every period, on drawn and on periodic words."""

import hashlib

import numpy as np
import pytest

from seqtables.llm.runs import find_runs, periodic_runs, planted_order

EMPTY = hashlib.sha256(b"").hexdigest()


def every_run(words, least=12):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j + period - i >= max(least, 2 * period) and j > i:
                found.setdefault((i, j + period), period)
            i = max(i, j) + 1
    return sorted((s, p, e) for (s, e), p in found.items())


def drawn(seed):
    draw = np.random.default_rng(seed)
    kind, n = seed % 5, int(draw.integers(1, 260))
    if kind == 0:
        return draw.integers(0, 1 + seed % 3, n)
    if kind == 1:
        words = np.resize(draw.integers(0, 3, int(draw.integers(1, 60))), n)
        words[draw.integers(0, n, seed % 3)] = 9
        return words
    if kind == 2:
        unit = [[0, 1], [0, 0, 1], [0, 1, 2, 0, 1]][seed % 3]
        parts = [np.resize(unit[:: draw.choice([1, -1])], draw.integers(1, 70)) for _ in range(4)]
        return np.concatenate(parts)
    if kind == 3:
        a, b = [1], [0]
        while len(a) < n:
            a, b = a + b, a
        return np.array(a[:n])
    small = np.resize(draw.integers(0, 2, int(draw.integers(1, 9))), draw.integers(4, 60))
    unit = np.concatenate((small, draw.integers(0, 3, 2)))
    return np.concatenate((draw.integers(0, 3, 5), np.resize(unit, len(unit) * 4 + 3)))


@pytest.mark.parametrize("least", [2, 12])
def test_all_runs_of_drawn_words(least):
    for seed in range(400):
        words = np.unique(drawn(seed), return_inverse=True)[1].astype(np.int32)
        start, end, period = find_runs(words, least).tolist()
        assert list(zip(start, period, end)) == every_run(words.tolist(), least), seed


def test_long_runs_take_little():
    words = np.resize(np.r_[np.resize([0, 1], 10_000), 0], 300_000).astype(np.int32)
    start, end, period = find_runs(words)
    assert [0, 300_000, 10_001] in np.stack((start, end, period), axis=1).tolist()
    assert find_runs(np.zeros(300_000, np.int32)).tolist() == [[0], [300_000], [1]]


def test_rows(spark, docs):
    line = "to be or not\x0bto  be "
    long = " ".join(f"w{i % 700}" for i in range(2_100))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, line * 3), (4, line * 3), (None, line * 3), (6, long), (8, "a\xa0b " * 12)]
    found = periodic_runs(docs(rows), "doc_id", "text").collect()
    assert len(found) == len(rows)
    by_id = {r["row_id"]: r for r in found}
    for empty in (1, 2, 3):
        assert by_id[empty]["n_runs"] == 0 and by_id[empty]["period"] is None
        assert by_id[empty]["collapsed_sha256"] == by_id[empty]["runs_sha256"] == EMPTY
    assert [r["runs"] for r in found if r["row_id"] in (4, None)] == [[(0, 18, 6)]] * 3
    assert by_id[4]["collapsed_sha256"] == hashlib.sha256(b"to be or not to be").hexdigest()
    assert by_id[4]["exponent_milli"] == 3_000
    assert (by_id[6]["start"], by_id[6]["length"], by_id[6]["period"]) == (0, 2_100, 700)
    # Only ASCII blanks part words.
    assert (by_id[8]["length"], by_id[8]["period"]) == (12, 1)
    assert periodic_runs(docs([]), "doc_id", "text").count() == 0


def test_text_ids_and_ties(spark):
    text = "a " * 12 + "x " + "b " * 12
    frame = spark.createDataFrame([("k", text)], "name string, runs string")
    [row] = periodic_runs(frame, "name", "runs").collect()
    assert (row["row_id"], row["n_runs"], row["start"]) == ("k", 2, 0)
    assert row["runs_sha256"] == hashlib.sha256(b"0,12,1\n13,12,1\n").hexdigest()


def test_planted_order():
    keys = [k for k in range(2_000) if planted_order(k, 50) is not None]
    assert 100 < len(keys) < 300
    for key in keys[:50]:
        order = planted_order(key, 50).tolist()
        edge = next((i for i, x in enumerate(order) if x != i), 50)
        assert sorted(set(order)) == list(range(edge))
    assert planted_order(None, 5) is None and planted_order(keys[0], 0) is None
