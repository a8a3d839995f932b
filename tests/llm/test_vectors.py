"""Near copies among vectors against all pairs, on planted groups, hot groups and odd rows."""

import numpy as np
import pytest

from seqtables.llm.components import components, stars
from seqtables.llm.vectors import near_vectors, sketches, table_shape

SCHEMA = "vec_id long, embedding array<double>, cid long, links long, bucket string"


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 7, 8, "x") for i, v in rows], SCHEMA)

    return make


def all_pairs(ids, matrix, threshold=0.95):
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return near.sum(axis=1), [min(ids[j] for j in np.flatnonzero(label == k)) for k in label]


def planted(draw, groups, size, length, cosine):
    """Groups around a centre with members at the given cosine to it."""
    rows = []
    for _ in range(groups):
        centre = draw.standard_normal(length)
        centre /= np.linalg.norm(centre)
        rows.append(centre * draw.uniform(0.1, 10))
        for _ in range(size):
            side = draw.standard_normal(length)
            side -= side @ centre * centre
            side /= np.linalg.norm(side)
            rows.append((cosine * centre + np.sqrt(1 - cosine**2) * side) * draw.uniform(0.1, 10))
    return np.array(rows)


def test_planted_groups(vectors):
    draw = np.random.default_rng(5)
    parts = [draw.standard_normal((300, 24))]
    parts += [planted(draw, 30, 3, 24, c) for c in (0.951, 0.96, 0.98, 0.999)]
    # One hot group, larger than the small runs and than a block of the test.
    parts.append(planted(draw, 1, 150, 24, 0.99))
    matrix = np.concatenate(parts)
    ids = draw.permutation(len(matrix)).tolist()
    links, component = all_pairs(ids, matrix)
    frame = vectors([(i, v.tolist()) for i, v in zip(ids, matrix)])
    for block in (40, 1_024):
        found = {r["row_id"]: r for r in near_vectors(frame, "vec_id", "embedding", block_rows=block).collect()}
        got = np.array([found[i]["n_links"] for i in ids])
        assert (got <= links).all() and got.sum() >= 0.99 * links.sum()
        same = [found[i]["component_id"] == c for i, c in zip(ids, component)]
        assert np.mean(same) >= 0.99
        assert all(r["kept"] == (r["row_id"] == r["component_id"]) for r in found.values())


def test_odd_rows(vectors):
    v = [3.0, 4.0]
    rows = [
        (5, v), (5, v), (2, [6.0, 8.0]), (None, v), (9, [3e200, 4e200]), (8, [-3.0, -4.0]),
        (1, None), (3, []), (4, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
        (10, [None, 1.0]), (11, [3.0, 4.0, 0.0]), (None, [1.0, -1.0]), (12, [-0.0, 5.0]), (13, [0.0, 5.0]),
    ]
    found = near_vectors(vectors(rows), "vec_id", "embedding").collect()
    got = sorted(((r["row_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=str)
    alone = [(i, 0, i, True) for i in (1, 3, 4, 6, 7, 8, 10, 11)]
    group = [(5, 4, 2, False), (5, 4, 2, False), (2, 4, 2, True), (None, 4, 2, False), (9, 4, 2, False)]
    zeros = [(12, 1, 12, True), (13, 1, 12, False)]
    assert got == sorted([*alone, *group, *zeros, (None, 0, None, False)], key=str)


def test_none_links_below_and_ties(vectors):
    at = [0.95, float(np.sqrt(1 - 0.95**2))]
    below = [0.9499, float(np.sqrt(1 - 0.9499**2))]
    found = near_vectors(vectors([(1, [1.0, 0.0]), (2, below)]), "vec_id", "embedding").collect()
    assert [r["n_links"] for r in found] == [0, 0]
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(i, at) for i in range(40, 50)]
    found = near_vectors(vectors(rows), "vec_id", "embedding", threshold=0.9499999).collect()
    assert {r["component_id"] for r in found} == {0} and {r["n_links"] for r in found} == {49}


def test_empty_table(vectors):
    assert near_vectors(vectors([]), "vec_id", "embedding").count() == 0


def test_shape_of_the_tables():
    for rows in (10, 10_000, 10**9):
        bits, tables = table_shape(rows, 0.95, 0.002)
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 2**bits > 4 * rows and (1 - same) ** tables <= 0.002


def test_sketches_share_signs_as_angles_do():
    draw = np.random.default_rng(1)
    pairs = planted(draw, 400, 1, 32, 0.95)
    marks = sketches(pairs, 8, 50, 3)
    rate = (marks[::2] == marks[1::2]).mean()
    assert rate == pytest.approx((1 - np.arccos(0.95) / np.pi) ** 8, abs=0.02)


def test_stars():
    label = stars(np.array([0, 3, 4, 6]), np.array([3, 4, 2, 5]), 8)
    assert label.tolist() == [0, 1, 0, 0, 0, 5, 5, 7]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components_in_one_task_and_in_steps(spark, limit):
    draw = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + int(j)) for j in range(1, 60)] + [(7, 7), (500, 400), (500, 400)]
    edges += [(int(a), int(b)) for a, b in draw.integers(1_000, 1_200, (120, 2))]
    found = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b", limit).collect())
    ids = np.unique(edges)
    place = np.searchsorted(ids, np.array(edges))
    root = ids[stars(place[:, 0], place[:, 1], len(ids))]
    assert found == {i: r for i, r in zip(ids.tolist(), root.tolist()) if i != r}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", limit).count() == 0
