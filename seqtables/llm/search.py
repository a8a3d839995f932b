"""Operator 11: the best documents for each item by an integer lexical score, with two trees.

A document's score for an item sums, over the item's terms, the term's weight times an impact that
grows with the term's count and falls with the document's length (see ``weights`` and ``impacts``).

1. Postings. One pass over the texts keeps, for every document, its number of terms and the counts of
   terms that items hold; numbers of documents and of terms come from these rows alone.
2. Trees. Each task deals its documents into blocks and orders a block by halves, every half split
   by the term that parts it best; runs of ``DOC_LEAF`` documents are leaves, ``FAN`` nodes make one
   above. Items are ordered alike into trees of at most ``TREE_ITEMS``. A node holds the maximum of
   every coordinate below it: impacts on the side of documents, weights on that of items.
3. Search. The product of two nodes bounds every score below them. Both trees are walked together
   from the top; a pair of nodes goes when its bound is below the weakest kth score of the node's
   items, which only removes what cannot be an answer. Surviving pairs of leaves are scored exactly.
4. Seeds. The same search over one document of ``SEED_SHARE`` gives each item's first kth score, a
   lower bound of the true one; the whole table is then searched with it. Results of all tasks are
   merged by a ranking window.

Items are a stated query set: they are broadcast in chunks of at most ``MAX_BYTES`` of text or one
item, and a larger set takes more passes. All sums are whole numbers, in doubles while they stay
exact and in 64-bit integers beyond.

Defined results: null and empty texts, and texts without terms, are no documents and are not counted;
items without terms, or that no document shares a term with, have no rows; every row of items is an
item of its own, also one that repeats an id or has a null one; repeated document rows are documents
of their own and take a place each; equal scores go by ascending id, null ids last; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqtables.llm.tables import stored
from seqtables.llm.words import ALNUM, as_bytes

TOP = 10
MAX_BYTES = 4_000_000
SEED_SHARE = 64
# Sizes of leaves, children of a node, items of a tree; rows and postings of a block of documents.
DOC_LEAF, ITEM_LEAF, FAN = 8, 1, 4
TREE_ITEMS = 256
BLOCK_ROWS, BLOCK_POSTINGS = 2_048, 1_000_000
EXACT = 1 << 53


def terms_of(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else as_bytes(text)
    return raw.translate(ALNUM).split()


def weights(found: np.ndarray, n_docs: int) -> np.ndarray:
    """Whole weights of terms that ``found`` documents hold."""
    return np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in found.tolist()], np.int64
    )


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole impacts of counts ``tf`` in documents of ``n`` terms."""
    m = 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def halved_order(owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, leaf: int) -> np.ndarray:
    """An order of ``n`` rows in which rows of one leaf share heavy terms.

    The rows of a node are parted by the term with the most weight on both sides, then cut in the
    middle. ``owner, term, weight`` list the coordinates of the rows.
    """
    order, size = np.arange(n), 1
    while size < n:
        size *= 2
    while size > leaf:
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        node = place[owner] // size
        key = node * (int(term.max(initial=0)) + 1) + term
        keys, where = np.unique(key, return_inverse=True)
        count = np.bincount(where)
        heavy = np.zeros(len(keys))
        np.maximum.at(heavy, where, weight)
        nodes = keys // (int(term.max(initial=0)) + 1)
        held = np.minimum(size, n - nodes * size)
        gain = heavy * np.minimum(count, held - count)
        best = np.zeros(-(-n // size))
        np.maximum.at(best, nodes, gain)
        chosen = np.flatnonzero((gain > 0) & (gain == best[nodes]))
        chosen = chosen[np.unique(nodes[chosen], return_index=True)[1]]
        has = np.zeros(n, bool)
        has[owner[np.isin(where, chosen)]] = True
        order = order[np.lexsort((np.arange(n), ~has[order], np.arange(n) // size))]
        size //= 2
    return order


def raised(maxima: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Coordinate maxima of the nodes of each level, the top first, from those of all rows."""
    levels, step = [], leaf
    while True:
        pad = -len(maxima) % step
        full = np.concatenate((maxima, np.zeros((pad, maxima.shape[1]), maxima.dtype)))
        maxima = full.reshape(-1, step, maxima.shape[1]).max(axis=1)
        levels.insert(0, maxima)
        if len(maxima) <= 1:
            return levels
        step = FAN


def node_least(values: np.ndarray, size: int) -> np.ndarray:
    return np.minimum.reduceat(values, np.arange(0, len(values), size))


@dataclass
class ItemTree:
    """Items in tree order with their coordinates as ``(place, term)``."""

    items: np.ndarray
    place: np.ndarray
    term: np.ndarray


def item_trees(item: np.ndarray, term: np.ndarray, weight: np.ndarray) -> list[ItemTree]:
    """Trees of the items with the coordinates ``(item, term)`` and a weight for each term."""
    known, owner = np.unique(item, return_inverse=True)
    order = halved_order(owner, term, weight[term], len(known), TREE_ITEMS)
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    trees = []
    for lo in range(0, len(known), TREE_ITEMS):
        part = order[lo : lo + TREE_ITEMS]
        mine = (place[owner] >= lo) & (place[owner] < lo + TREE_ITEMS)
        within, own = place[owner[mine]] - lo, term[mine]
        inner = halved_order(within, own, weight[own], len(part), ITEM_LEAF)
        spot = np.empty(len(part), np.int64)
        spot[inner] = np.arange(len(part))
        trees.append(ItemTree(known[part][inner], spot[within], own))
    return trees


class Best:
    """The best ``k`` documents so far for each item, and their weakest score."""

    def __init__(self, n_items: int, k: int, start: np.ndarray):
        self.k = k
        self.kth = np.maximum(start, 1)
        self.rows: list[list[tuple]] = [[] for _ in range(n_items)]
        self.scored = self.pairs = 0

    def offer(self, item: int, found: list[tuple]) -> None:
        """``found`` has ``(-score, id is null, id)``; smaller is better."""
        rows = sorted(self.rows[item] + found)[: self.k]
        self.rows[item] = rows
        if len(rows) == self.k:
            self.kth[item] = max(self.kth[item], -rows[-1][0])


class DualTree:
    """Searches blocks of documents for all items."""

    def __init__(self, trees: list[ItemTree], weight: np.ndarray, n_items: int, start: np.ndarray, k: int):
        self.trees, self.weight = trees, weight
        # Impacts are below a million, so no bound exceeds a million times all weights.
        self.kind = np.float64 if int(weight.sum()) * 1_000_000 < EXACT else np.int64
        self.best = Best(n_items, k, start)

    def block(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: list) -> None:
        """Documents ``ids`` with the coordinates ``(owner, term, impact)``, by owner."""
        if len(owner) == 0:
            return
        columns, column = np.unique(term, return_inverse=True)
        worth = self.weight[columns][column] * impact
        order = halved_order(owner, column, worth, len(ids), DOC_LEAF)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        spot = place[owner]
        leaves = -(-len(ids) // DOC_LEAF)
        low = np.zeros((leaves, len(columns)), self.kind)
        np.maximum.at(low, (spot // DOC_LEAF, column), impact)
        docs = raised(low, 1)
        by_leaf = np.argsort(spot, kind="stable")
        cuts = np.searchsorted(spot[by_leaf], np.arange(0, leaves * DOC_LEAF + 1, DOC_LEAF))
        rows = (spot[by_leaf] % DOC_LEAF, column[by_leaf], impact[by_leaf])
        for tree in self.trees:
            self.walk(tree, docs, columns, rows, cuts, [ids[i] for i in order.tolist()])

    def walk(self, tree: ItemTree, docs: list, columns: np.ndarray, rows: tuple, cuts: np.ndarray, ids: list) -> None:
        at = np.searchsorted(columns, tree.term)
        at[at == len(columns)] = 0
        held = columns[at] == tree.term
        items = np.zeros((len(tree.items), len(columns)), self.kind)
        items[tree.place[held], at[held]] = self.weight[tree.term[held]]
        nodes = raised(items, ITEM_LEAF)
        kth = self.best.kth[tree.items]
        depth = max(len(docs), len(nodes))
        # The shorter tree waits at its root.
        alive = np.ones((1, 1), bool)
        bound = alive
        for level in range(depth):
            d, i = level - depth + len(docs), level - depth + len(nodes)
            side_d, side_i = docs[max(d, 0)], nodes[max(i, 0)]
            if d > 0:
                alive = np.repeat(alive, FAN, axis=0)[: len(side_d)]
            if i > 0:
                alive = np.repeat(alive, FAN, axis=1)[:, : len(side_i)]
            weakest = node_least(kth, ITEM_LEAF * FAN ** (len(nodes) - 1 - max(i, 0)))
            some_d, some_i = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if len(some_d) == 0:
                return
            bound = np.zeros(alive.shape, self.kind)
            bound[np.ix_(some_d, some_i)] = side_d[some_d] @ side_i[some_i].T
            alive &= bound >= weakest
        self.best.pairs += alive.size
        # Leaves of the highest bounds first, so that the weakest scores rise early.
        tops = np.where(alive, bound, 0).max(axis=1)
        for leaf in np.argsort(-tops, kind="stable").tolist():
            if tops[leaf] == 0:
                break
            weakest = node_least(self.best.kth[tree.items], ITEM_LEAF)
            live = np.flatnonzero(alive[leaf] & (bound[leaf] >= weakest))
            if len(live) == 0:
                continue
            self.best.scored += len(live)
            span = slice(cuts[leaf], cuts[leaf + 1])
            used, narrow = np.unique(rows[1][span], return_inverse=True)
            part = np.zeros((DOC_LEAF, len(used)), self.kind)
            part[rows[0][span], narrow] = rows[2][span]
            chosen = (live[:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
            chosen = chosen[chosen < len(tree.items)]
            scores = part @ items[np.ix_(chosen, used)].T
            near = scores >= self.best.kth[tree.items[chosen]]
            for j in np.flatnonzero(near.any(axis=0)).tolist():
                found = []
                for r in np.flatnonzero(near[:, j]).tolist():
                    name = ids[leaf * DOC_LEAF + r]
                    found.append((-int(scores[r, j]), name is None, name))
                self.best.offer(int(tree.items[chosen[j]]), found)


def chunked(items: DataFrame, item: str, text: str, most: int) -> DataFrame:
    """Stored items ``(_item, item, text, size, chunk)``; a chunk has ``most`` bytes or one item."""
    rows = items.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = rows.withColumn("_item", F.monotonically_increasing_id())
    sized = stored(numbered.withColumn("size", F.octet_length("text")), "search-items")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    bins = -(-total // most) or 1
    while True:
        dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("_item"), F.lit(bins)))
        chunk = dealt.groupBy("chunk").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        if chunk.filter((F.col("b") > most) & (F.col("n") > 1)).isEmpty():
            return dealt
        bins *= 2


def postings(docs: DataFrame, row_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(row_id, n, terms, tfs)`` for each document with a term."""
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["row_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            kept, sizes, owner, codes = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                words = terms_of(value.as_py())
                if not words:
                    continue
                known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                known, tf = np.unique(known[known >= 0], return_counts=True)
                kept.append(i)
                sizes.append(len(words))
                owner.append(known)
                codes.append(tf)
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in owner]))).astype(np.int32)
            terms, tfs = (
                pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([[], *x]).astype(np.int32)))
                for x in (owner, codes)
            )
            ids = batch.column(0).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), terms, tfs], NAMES)

    return rows.mapInArrow(count, f"row_id {kind}, n long, terms array<int>, tfs array<int>")


NAMES = ["row_id", "n", "terms", "tfs"]


def term_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary, summed in tasks and then over them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=size)
        term = np.flatnonzero(total)
        columns = [pa.array(term.astype(np.int32)), pa.array(total[term])]
        yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

    sums = rows.select("terms").mapInArrow(add, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in sums.collect():
        out[row["term"]] = row["n"]
    return out


def tree_search(rows: DataFrame, sent, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(place, row_id, score)``: each task's best documents for the items of one chunk.

    ``sent`` is a broadcast of the item trees, weights, number of items and starting scores.
    """
    kind = rows.schema["row_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, weight, n_items, start = sent.value
        tree = DualTree([ItemTree(*part) for part in parts], weight, n_items, start, k)
        id_kind = None
        for batch in batches:
            id_kind = batch.schema.types[0]
            sizes = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            term = np.asarray(batch.column(2).flatten()).astype(np.int64)
            tf = np.asarray(batch.column(3).flatten()).astype(np.int64)
            impact = impacts(tf, np.asarray(batch.column(1))[owner], n_docs, n_terms)
            ids = batch.column(0).to_pylist()
            ends = np.cumsum(sizes)
            lo = 0
            while lo < batch.num_rows:
                before = ends[lo] - sizes[lo]
                full = int(np.searchsorted(ends, before + BLOCK_POSTINGS, side="right"))
                hi = min(max(full, lo + 1), lo + BLOCK_ROWS)
                span = slice(before, ends[hi - 1] if hi <= len(ends) else None)
                hi = min(hi, batch.num_rows)
                tree.block(owner[span] - lo, term[span], impact[span], ids[lo:hi])
                lo = hi
        found = [(i, r[2], -r[0]) for i, best in enumerate(tree.best.rows) for r in best]
        place, name, score = zip(*found) if found else ((), (), ())
        if id_kind is not None:
            columns = [pa.array(place, pa.int32()), pa.array(name, id_kind), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["place", "row_id", "score"])

    return rows.mapInArrow(search, f"place int, row_id {kind}, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("row_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, row_id: str, text: str, item: str = "item_id",
    item_text: str = "text", k: int = TOP, most: int = MAX_BYTES,
) -> DataFrame:
    """``(item, rank, row_id, score)``: the ``k`` best documents of every item, best first."""
    spark = docs.sparkSession
    asked = chunked(items, item, item_text, most)
    chunks = sorted(r["chunk"] for r in asked.select("chunk").distinct().collect()) or [0]
    parts = []
    for chunk in chunks:
        # One chunk's texts, at most ``most`` bytes or one item.
        held = asked.filter(F.col("chunk") == chunk).select("_item", "text").orderBy("_item").collect()
        vocabulary: dict[bytes, int] = {}
        pairs = [
            (place, vocabulary.setdefault(word, len(vocabulary)))
            for place, row in enumerate(held)
            for word in sorted(set(terms_of(row["text"])))
        ]
        rows = stored(postings(docs, row_id, text, vocabulary), "search-postings")
        sums = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        matched = rows.filter(F.size("terms") > 0)
        weight = weights(term_counts(matched, len(vocabulary)), sums["docs"])
        owner, term = np.array(pairs, np.int64).reshape(-1, 2).T
        # Plain arrays, so that executors need no package to read them.
        trees = [(t.items, t.place, t.term) for t in item_trees(owner, term, weight)]
        context = spark.sparkContext
        start = np.zeros(len(held), np.int64)
        seed = matched.filter(F.pmod(F.xxhash64("row_id", "n"), F.lit(SEED_SHARE)) == 0)
        plain = context.broadcast((trees, weight, len(held), start))
        first = best_of(tree_search(seed, plain, sums["docs"], sums["terms"], k), k)
        for row in first.filter(F.col("rank") == k).select("place", "score").collect():
            start[row["place"]] = row["score"]
        sent = context.broadcast((trees, weight, len(held), start))
        found = best_of(tree_search(matched, sent, sums["docs"], sums["terms"], k), k)
        names = [(i, r["_item"]) for i, r in enumerate(held)]
        named = found.join(F.broadcast(spark.createDataFrame(names, "place int, _item long")), "place")
        parts.append(stored(named.select("_item", "rank", "row_id", "score"), "search-results"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.join(asked.select("_item", "item"), "_item").select("item", "rank", "row_id", "score")
