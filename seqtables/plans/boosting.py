"""Histogram gradient boosting of all classes at once.

Features are binned once by quantile sketches over all rows. A tree grows level by level: rows are
summed to gradients and Hessians by (class, node, feature, bin), and every node takes the cut of the
largest gain. Gradients are whole numbers of 1 / ``SCALE``, so sums are exact and neither partitions
nor retries show in a model.

A pass over the rows is a Spark job that sums all classes together and splits the nodes where their
sums meet; only one row a node reaches the driver. Rows that fit one task by their counted cells are
dealt once for each class instead, and each class grows all its trees in its task: the same sums and
splits without a job for each level. There only the smaller child of a cut is summed, the other is what
its parent has beyond it, and two features are summed by one joint key where rows outnumber such keys.
Both ways give the same trees, since the sums are exact.

Defined results: missing and NaN values are larger than every cut; a feature of one value is never cut;
equal gains take the lowest feature, then the lowest cut; a row without a label counts as negative.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.session import stored_table

SCALE = 1 << 20
# Below this a gain counts as none.
LEAST_GAIN = 1e-6
# Bytes of binned features one task may hold; more rows take a job for each level.
TASK_CELLS = 32_000_000
# Cells of one histogram call, and rounds after which margins are stored anew.
CHUNK_CELLS = 4_000_000
STORE_ROUNDS = 8


@dataclass
class BoostedTrees:
    """Trees of one class, each complete to its depth: inner node ``i`` has ``2i + 1`` and ``2i + 2``.

    A node that was not cut has the cut ``inf`` and one value in all leaves below.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        rows, total = np.arange(len(x)), np.zeros(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 2 - (x[rows, feature[node]] <= cut[node])
            total += leaf[node - inner]
        return total


def boosted_logits(models: Sequence[BoostedTrees], features: Column) -> Column:
    """Array of the log-odds of each model."""

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = dense(column)
            scores = np.stack([m.logits(x) for m in models], axis=1)
            cuts = np.arange(0, scores.size + 1, len(models), dtype=np.int32)
            yield pa.ListArray.from_arrays(cuts, pa.array(scores.ravel()))

    return score(features.cast("array<double>"))


def dense(column: pa.Array) -> np.ndarray:
    """Matrix of a column of arrays of one length; nulls are NaN."""
    if len(column) == 0:
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def quantile_cuts(rows: DataFrame, bins: int, features: str = "features") -> list[np.ndarray]:
    """At most ``bins - 1`` cuts for each feature: quantiles, so every frequent value is one."""
    cells = rows.select(F.posexplode(features).alias("f", "v")).filter("v IS NOT NULL AND NOT isnan(v)")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = cells.groupBy("f").agg(
        F.percentile_approx("v", shares, F.lit(100 * bins)).alias("cuts"), F.max("v").alias("top")
    )
    width = rows.agg(F.max(F.size(features)).alias("n")).first()["n"] or 0
    out = [np.empty(0)] * width
    for row in found.collect():
        cuts = np.unique(np.array(row["cuts"]))
        out[row["f"]] = cuts[cuts < row["top"]]
    return out


def binned_rows(rows: DataFrame, cuts: list[np.ndarray], n_classes: int, features: str, y: str) -> DataFrame:
    """Stored ``(x, y)``: a byte for each feature's bin, and a byte for each class."""

    def bin_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column(0))
            place = np.empty(x.shape, np.uint8)
            for f, c in enumerate(cuts):
                place[:, f] = np.searchsorted(c, x[:, f])
            truth = [bytes(int(v or 0) for v in (r or [])[:n_classes]).ljust(n_classes, b"\0") for r in batch.column(1).to_pylist()]
            columns = [pa.array([r.tobytes() for r in place], pa.binary()), pa.array(truth, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["x", "y"])

    pair = rows.select(F.col(features).cast("array<double>"), F.col(y).cast("array<int>"))
    return stored_table(pair.mapInArrow(bin_up, "x binary, y binary"), "boosting-rows")


@dataclass
class Settings:
    trees: int
    depth: int
    rate: float
    bins: int
    l2: float
    least_weight: float
    width: int


def gradients(margin: np.ndarray, y: np.ndarray, heavier: float) -> np.ndarray:
    """Gradient and Hessian of the log loss as whole numbers, two rows; positives weigh ``heavier``."""
    p = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, heavier, 1.0) * SCALE
    return np.rint(np.stack(((p - y) * w, p * (1 - p) * w)))


def histograms(x: np.ndarray, node: np.ndarray, sums: np.ndarray, nodes: int, s: Settings) -> np.ndarray:
    """Sums by ``(gradient or Hessian, node, feature, bin)``; rows of a negative node are left out."""
    out = np.zeros((2, nodes * s.width * s.bins))
    step = max(1, CHUNK_CELLS // max(1, s.width))
    inside = np.flatnonzero(node >= 0)
    for lo in range(0, len(inside), step):
        at = inside[lo : lo + step]
        key = (node[at][:, None] * s.width + np.arange(s.width)) * s.bins + x[at]
        for i in range(2):
            weight = np.broadcast_to(sums[i][at][:, None], key.shape)
            out[i] += np.bincount(key.ravel(), weight.ravel(), minlength=out.shape[1])
    return out.reshape(2, nodes, s.width, s.bins)


class Sums:
    """Histograms of rows kept in one task, feature by feature; the same sums as ``histograms``."""

    def __init__(self, x: np.ndarray, s: Settings):
        self.s = s
        self.columns = np.ascontiguousarray(x.T)
        wide = self.columns.astype(np.uint16)
        # Bins of two neighbouring features as one key.
        self.joint = wide[0 : s.width - 1 : 2] * np.uint16(s.bins) + wide[1::2]

    def add(self, rows: np.ndarray | None, rank: np.ndarray, sums: np.ndarray, nodes: int) -> np.ndarray:
        """Sums by ``(gradient or Hessian, node, feature, bin)`` of some rows, ``None`` for all."""
        s = self.s
        out = np.empty((2, nodes, s.width, s.bins))
        paired = len(self.joint) if len(rank) > nodes * s.bins**2 else 0
        key = np.empty(len(rank), np.int64)

        def summed(column: np.ndarray, cells: int) -> Iterator[np.ndarray]:
            np.add(base, column if rows is None else column.take(rows, mode="clip"), out=key)
            for weight in sums:
                yield np.bincount(key, weight, minlength=nodes * cells).reshape(nodes, -1, s.bins)

        base = rank * s.bins**2
        for p in range(paired):
            for i, found in enumerate(summed(self.joint[p], s.bins**2)):
                out[i, :, 2 * p] = found.sum(axis=2)
                out[i, :, 2 * p + 1] = found.sum(axis=1)
        base = rank * s.bins
        for f in range(2 * paired, s.width):
            for i, found in enumerate(summed(self.columns[f], s.bins)):
                out[i, :, f] = found[:, 0]
        return out


def best_cuts(hist: np.ndarray, s: Settings) -> list[tuple]:
    """For each node ``(feature, bin, g and h left, g and h right)``; feature -1 if no cut gains."""
    total = hist[:, :, :1, :].sum(axis=3)[..., None]
    left = np.cumsum(hist, axis=3)[..., :-1]
    right = total - left
    least = s.least_weight * SCALE
    fits = (left[1] >= least) & (right[1] >= least)

    def worth(part: np.ndarray) -> np.ndarray:
        return (part[0] / SCALE) ** 2 / (part[1] / SCALE + s.l2)

    gain = np.zeros(fits.shape)
    before = np.broadcast_to(worth(total), fits.shape)[fits]
    gain[fits] = (worth(left[:, fits]) + worth(right[:, fits]) - before) / 2
    flat = gain.reshape(len(gain), -1)
    top = flat.argmax(axis=1)
    out = []
    for i, j in enumerate(top.tolist()):
        f, b = divmod(j, s.bins - 1)
        if flat[i, j] <= LEAST_GAIN:
            whole = total[:, i, 0, 0]
            out.append((-1, -1, *whole.tolist(), 0.0, 0.0))
        else:
            out.append((f, b, *left[:, i, f, b].tolist(), *right[:, i, f, b].tolist()))
    return out


class Growing:
    """One tree while it grows: cuts of inner nodes as bins, and values of leaves."""

    def __init__(self, s: Settings):
        self.s = s
        self.feature = np.zeros((1 << s.depth) - 1, np.int32)
        # A bin no value exceeds: the node passes its rows on to the left.
        self.bin = np.full((1 << s.depth) - 1, 255, np.int16)
        self.leaf = np.zeros(1 << s.depth)
        self.open = [0]

    def add(self, level: int, cuts: list[tuple]) -> None:
        """The cuts of the open nodes of a level; children are open on the next one."""
        nodes, self.open = self.open, []
        for node, (f, b, gl, hl, gr, hr) in zip(nodes, cuts):
            if f < 0:
                self.settle(node, level, gl, hl)
                continue
            self.feature[node], self.bin[node] = f, b
            for child, g, h in ((2 * node + 1, gl, hl), (2 * node + 2, gr, hr)):
                # Both sides of a cut need the least weight.
                if level + 1 == self.s.depth or h < 2 * self.s.least_weight * SCALE:
                    self.settle(child, level + 1, g, h)
                else:
                    self.open.append(child)

    def settle(self, node: int, level: int, g: float, h: float) -> None:
        """One value for all leaves below ``node``."""
        down = self.s.depth - level
        first = ((node + 1) << down) - (1 << self.s.depth)
        self.leaf[first : first + (1 << down)] = -self.s.rate * (g / SCALE) / (h / SCALE + self.s.l2)

    def places(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` cuts."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(levels):
            node = 2 * node + 2 - (x[rows, self.feature[node]] <= self.bin[node])
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.leaf[self.places(x, self.s.depth) - len(self.feature)]

    def ranks(self, node: np.ndarray) -> np.ndarray:
        """Place of each row's node among the open ones, -1 if it is settled."""
        rank = np.full(2 * len(self.feature) + 1, -1)
        rank[self.open] = np.arange(len(self.open))
        return rank[node]


def grow_class(x: np.ndarray, y: np.ndarray, heavier: float, s: Settings) -> Iterator[Growing]:
    """All trees of one class from rows of one task."""
    margin, store, cells = np.zeros(len(x)), Sums(x, s), np.ascontiguousarray(x).reshape(-1)
    first = np.arange(len(x)) * s.width
    inner = (1 << s.depth) - 1
    for _ in range(s.trees):
        tree, sums = Growing(s), gradients(margin, y, heavier)
        node = np.zeros(len(x), np.int64)
        hist = store.add(None, node, sums, 1)
        for level in range(s.depth):
            if tree.open:
                before = dict(zip(tree.open, range(len(tree.open))))
                tree.add(level, best_cuts(hist, s))
            node = 2 * node + 1 + (cells[first + tree.feature[node]] > tree.bin[node])
            if tree.open and level + 1 < s.depth:
                hist = child_sums(store, hist, before, tree.open, node, sums)
        margin += tree.leaf[node - inner]
        yield tree


def child_sums(
    store: Sums, hist: np.ndarray, before: dict[int, int], nodes: list[int], node: np.ndarray, sums: np.ndarray
) -> np.ndarray:
    """Sums of the open ``nodes`` from those of their parents, ``before`` their places in ``hist``."""
    sizes = np.bincount(node, minlength=max(nodes) + 2)
    parents = sorted({(n - 1) // 2 for n in nodes})
    least = [min(2 * p + 1, 2 * p + 2, key=lambda n: sizes[n]) for p in parents]
    rank = np.full(len(sizes), -1)
    rank[least] = np.arange(len(least))
    place = rank[node]
    rows = np.flatnonzero(place >= 0)
    small = store.add(rows, place[rows], np.ascontiguousarray(sums[:, rows]), len(least))
    out = np.empty((2, len(nodes), *hist.shape[2:]))
    for i, n in enumerate(nodes):
        p = (n - 1) // 2
        part = small[:, parents.index(p)]
        out[:, i] = part if rank[n] >= 0 else hist[:, before[p]] - part
    return out


TREE = "c int, tree int, feature array<int>, bin array<int>, leaf array<double>"


def matrix(column: Sequence[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


def grow_in_tasks(rows: DataFrame, weights: dict[int, float], s: Settings) -> list[list[Growing]]:
    """A task for each class; the binned rows are dealt to every class."""
    classes = sorted(weights)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        c = int(key[0])
        x, y = matrix(frame["x"], s.width), frame["label"].to_numpy()
        trees = [(c, i, t.feature, t.bin, t.leaf) for i, t in enumerate(grow_class(x, y, weights[c], s))]
        return pd.DataFrame(trees, columns=["c", "tree", "feature", "bin", "leaf"])

    label = F.conv(F.hex(F.substring("y", F.col("c") + 1, F.lit(1))), 16, 10).cast("int")
    dealt = rows.select("x", "y", F.explode(F.array(*map(F.lit, classes))).alias("c"))
    # By range, so that every class has a task of its own.
    spread = dealt.select("c", "x", label.alias("label")).repartitionByRange(len(classes), "c")
    grown = spread.groupBy("c").applyInPandas(fit, TREE)
    out: dict[int, list] = {c: [] for c in classes}
    for row in stored_table(grown, "boosting-trees").orderBy("c", "tree").collect():
        tree = Growing(s)
        tree.feature, tree.bin, tree.leaf = (np.array(row[k]) for k in ("feature", "bin", "leaf"))
        out[row["c"]].append(tree)
    return [out[c] for c in classes]


def summed_level(rows: DataFrame, todo: list, s: Settings) -> dict[int, list[tuple]]:
    """One pass: the cuts of the open nodes of every class.

    ``todo`` has for each class its index, weight, trees since the margins were stored, the tree that
    grows and its level.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column(0).to_pylist(), s.width)
            truth = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(x), -1)
            margins = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(len(x), -1)
            for place, (c, heavier, fresh, tree, level) in enumerate(todo):
                margin = margins[:, place].copy()
                for old in fresh:
                    margin += old.values(x)
                node = tree.ranks(tree.places(x, level))
                found = histograms(x, node, gradients(margin, truth[:, c], heavier), len(tree.open), s)
                total[place] = total.get(place, 0) + found
        keys, blobs = [], []
        for place, hist in total.items():
            for i in range(hist.shape[1]):
                keys.append((place, i))
                blobs.append(hist[:, i].tobytes())
        columns = [pa.array([k[j] for k in keys], pa.int32()) for j in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], ["place", "node", "sums"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for place, node, blob in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.frombuffer(blob).reshape(2, 1, s.width, s.bins)
                total[place, node] = total.get((place, node), 0) + found
        out = [(*key, *best_cuts(hist, s)[0]) for key, hist in sorted(total.items())]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 4
        columns = [pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["place", "node", "f", "b", "gl", "hl", "gr", "hr"])

    partial = rows.mapInArrow(add, "place int, node int, sums binary")
    cuts = partial.repartition("place", "node").mapInArrow(
        split, "place int, node int, f int, b int, gl double, hl double, gr double, hr double"
    )
    out: dict[int, list[tuple]] = {}
    for row in cuts.orderBy("place", "node").collect():
        out.setdefault(row["place"], []).append(tuple(row)[2:])
    return out


def grow_in_passes(rows: DataFrame, weights: dict[int, float], s: Settings) -> list[list[Growing]]:
    """A job for each level of each round over all rows and classes; margins are stored now and then."""
    classes = sorted(weights)
    grown: list[list[Growing]] = [[] for _ in classes]
    kept = 0

    def with_margins(part: DataFrame, fresh: list[list[Growing]], known: bool) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(0).to_pylist(), s.width)
                before = np.zeros((len(x), len(classes)))
                if known:
                    before += np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(before.shape)
                for place, trees in enumerate(fresh):
                    for tree in trees:
                        before[:, place] += tree.values(x)
                margin = pa.array([r.tobytes() for r in before], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), margin], ["x", "y", "margin"])

        return stored_table(part.mapInArrow(add, "x binary, y binary, margin binary"), "boosting-margins")

    state = with_margins(rows, [[] for _ in classes], False)
    for turn in range(s.trees):
        if turn - kept == STORE_ROUNDS:
            state, kept = with_margins(state, [t[kept:] for t in grown], True), turn
        trees = [Growing(s) for _ in classes]
        for level in range(s.depth):
            todo = [(c, weights[c], grown[i][kept:], trees[i], level) for i, c in enumerate(classes)]
            if not any(t.open for t in trees):
                break
            for place, cuts in summed_level(state, todo, s).items():
                trees[place].add(level, cuts)
        for place, tree in enumerate(trees):
            grown[place].append(tree)
    return grown


def fit_boosted(
    train: DataFrame,
    weights: dict[int, float],
    n_classes: int,
    n_trees: int = 300,
    depth: int = 6,
    rate: float = 0.1,
    bins: int = 64,
    l2: float = 1.0,
    least_weight: float = 1.0,
    features: str = "features",
    y: str = "y",
    task_cells: int = TASK_CELLS,
) -> dict[int, BoostedTrees]:
    """Trees of each class in ``weights``, which has the weight of its positives. ``bins`` is 2 to 256."""
    cuts = quantile_cuts(train, bins, features)
    rows = binned_rows(train, cuts, n_classes, features, y)
    s = Settings(n_trees, depth, rate, bins, l2, least_weight, len(cuts))
    fits = rows.count() * max(1, len(cuts)) <= task_cells
    grown = (grow_in_tasks if fits else grow_in_passes)(rows, weights, s)
    padded = np.full((max(1, len(cuts)), 256), np.inf)
    for f, c in enumerate(cuts):
        padded[f, : len(c)] = c
    out = {}
    for c, trees in zip(sorted(weights), grown):
        feature = np.array([t.feature for t in trees])
        places = np.array([t.bin for t in trees])
        out[c] = BoostedTrees(feature, padded[feature, places], np.array([t.leaf for t in trees]))
    return out


def save_trees(spark: SparkSession, models: dict[int, BoostedTrees], path: str) -> None:
    """One row a tree below ``path``."""
    rows = [
        (c, i, m.feature[i].tolist(), m.cut[i].tolist(), m.leaf[i].tolist())
        for c, m in models.items()
        for i in range(len(m.feature))
    ]
    schema = "label_idx int, tree int, feature array<int>, cut array<double>, leaf array<double>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str) -> dict[int, BoostedTrees]:
    parts: dict[int, list] = {}
    for row in spark.read.parquet(path).orderBy("label_idx", "tree").collect():
        parts.setdefault(row["label_idx"], []).append(row)
    return {
        c: BoostedTrees(
            np.array([r["feature"] for r in rows], np.int32),
            np.array([r["cut"] for r in rows]),
            np.array([r["leaf"] for r in rows]),
        )
        for c, rows in parts.items()
    }
