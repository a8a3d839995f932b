"""Operator 3: exact n-gram Jaccard join by size bands, segments, bitmaps and sorted arrays.

A text's set is that of its distinct word shingles. Two sets link when ``100 * intersection >=
percent * union``. All linked pairs are found up to connectivity: classes of equal sets collapse
first, and a pair is skipped once both sides are known to be connected.

1. Size bands. Linked sets differ in size by the factor ``100 / percent`` at most, so with bands of
   that ratio the smaller set's band or the next one holds the larger.
2. Candidates. Within the pairs of a band, the symmetric difference has at most ``d`` elements. The
   hash space is cut into ``d + 1 + SPARE`` segments; at least ``1 + SPARE`` of them are equal in
   both sets. Every set gives one signature for each segment. A segment with no element says little
   and is left out, unless more than ``SPARE`` of a set's segments are empty: then one that is not
   empty might not be among the equal ones. With more than ``SURE_SEGMENTS`` segments, of which an
   eighth at most are empty, they are left out as well: differing elements fall on segments by their
   hashes and leave a third of them alone, so that all equal ones are empty has a chance below
   ``1e-12`` (as rare as a collision of hashes). Parity bitmaps bound the overlap from above, because
   every differing bit is an element of the symmetric difference; sets that share a signature and
   pass the bound are candidates. Long sets would fill their bitmap and pass whatever they hold: from
   ``WHOLE`` elements on it maps those that their hashes draw, half as many for each doubling of the
   size. How many of a linked pair's differing elements are drawn is bounded but for a chance of
   ``1e-15``.
3. Tiles. Candidate groups (components over candidates) are dealt into blocks of a bounded number
   of rows. In a tile, sets are sorted by size and bounded again; what passes is intersected
   exactly as sorted arrays.
4. Large groups. After the blocks, one set of every component found so far is dealt again; then
   blocks of the sets outside the group's largest component are compared with all blocks. Sets of
   one component are never compared again, so a large group of mutual copies costs its size.

Signatures are combined before the shuffle, so one that very many sets share costs a row for each
task. Texts are read twice: once for the sets, once for the candidates, whose narrow list is
broadcast if it is small and joined by a shuffle if not.

Defined results: null and empty texts, and texts without words, have an empty set and link with
nothing; fewer words than ``width`` are one shingle; equal sets always link, however many there are;
repeated rows stay separate rows; a row with a null id takes part through equal sets only; ids of
another type than integers are refused with a ``TypeError``; other columns are ignored. Component ids are the smallest id of the component.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.llm.components import components
from seqtables.llm.tables import integer_ids, parts, stored
from seqtables.llm.words import SPACED, WordHasher, mix, shingle_hashes
from seqtables.operators.joins import fits_broadcast

SPARE = 2
SURE_SEGMENTS = 64
BITS = 1024
# Size from which bitmaps hold a part of a set, and minus the logarithm of the chance that more
# elements are drawn than their bound admits.
WHOLE = 1024
DOUBT = 34.5
# Rows and shingles of a block: bound the memory of a tile, not what is compared.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 400_000
# Texts for each bucket of signatures, and signatures a task holds before it sends them.
BUCKET_ROWS = 4_096
FLUSH_PAIRS = 1_000_000


class Bands:
    """Size bands of ratio ``100 / percent`` with the segments of each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def grow(self) -> None:
        last = self.starts[-1]
        self.starts.append(max(last + 1, -(-last * 100 // self.percent)))

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.grow()
        return bisect_right(self.starts, n) - 1

    def segments(self, band: int) -> int:
        """Segments for pairs whose smaller set is in ``band``; 0 if only equal sets link."""
        while len(self.starts) < band + 2:
            self.grow()
        small = self.starts[band + 1] - 1
        both = small + small * 100 // self.percent
        most = both * (100 - self.percent) // (100 + self.percent)
        return most + 1 + SPARE if most else 0

    def schemes(self, n: int) -> list[tuple[int, int]]:
        """``(band, segments)`` a set of ``n`` elements takes part in."""
        own = self.of(n)
        found = [own]
        if own and -(-n * self.percent // 100) < self.starts[own]:
            found.append(own - 1)
        return [(b, s) for b in found if (s := self.segments(b))]


def signatures(members: np.ndarray, bands: Bands) -> np.ndarray:
    """One number for each segment of a sorted set, in each of its schemes."""
    if len(members) == 0:
        return members
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(members + np.uint64(7)), dtype=np.uint64)))
    high = members >> np.uint64(32)
    out = []
    for band, count in bands.schemes(len(members)):
        segment = (high * np.uint64(count)) >> np.uint64(32)
        cuts = np.searchsorted(segment, np.arange(count + 1, dtype=np.uint64))
        sums = total[cuts[1:]] - total[cuts[:-1]]
        tag = np.arange(count, dtype=np.uint64) + np.uint64((band + 1) << 32)
        marks = mix(sums + mix(tag))
        filled = cuts[1:] > cuts[:-1]
        empty = count - int(filled.sum())
        few = count > SURE_SEGMENTS and empty * 8 <= count
        out.append(marks[filled] if empty <= SPARE or few else marks)
    return np.concatenate(out) if out else members[:0]


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, width))


def set_key(members: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    first = mix(np.sum(members, dtype=np.uint64)[None] + np.uint64(len(members)))
    second = mix(np.sum(mix(members ^ np.uint64(0x5555555555555555)), dtype=np.uint64)[None])
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


def parity_bitmap(members: np.ndarray, level: int = 0) -> np.ndarray:
    """Parity of the members of each bit; of those drawn with a chance of ``2 ** -level``."""
    if level:
        # These bits of a hash name neither its place in the map nor its segment.
        draw = (members >> np.uint64(BITS.bit_length() - 1)) & np.uint64((1 << level) - 1)
        members = members[draw == 0]
    odd = np.bincount((members & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def levels(n: np.ndarray) -> np.ndarray:
    """The level of sets of ``n`` elements: 0 below ``WHOLE``, then one more for each doubling."""
    most = 32 - (BITS.bit_length() - 1)
    return np.clip(np.frexp(np.asarray(n) / WHOLE)[1], 0, most).astype(np.int64)


def depths(n: np.ndarray, percent: int) -> np.ndarray:
    """How many levels the sets have that may link with a set of ``n`` elements or fewer."""
    return levels(n) - levels(-(-np.asarray(n) * percent // 100)) + 1


def level_bitmaps(members: np.ndarray, percent: int) -> bytes:
    """Bitmaps of a set at its own level and at the lower ones of smaller sets it may link with."""
    own, depth = int(levels(len(members))), int(depths(len(members), percent))
    return b"".join(parity_bitmap(members, own - k).tobytes() for k in range(depth))


class Mapped:
    """Sizes, levels and bitmaps of sets; ``maps[i, k]`` is that of set ``i``, ``k`` levels down."""

    def __init__(self, n: np.ndarray, level: np.ndarray, maps: np.ndarray):
        self.n, self.level, self.maps = n, level, maps

    @classmethod
    def read(cls, n: np.ndarray, raw: bytes, percent: int) -> Mapped:
        """From the joined ``level_bitmaps`` of sets of ``n`` elements."""
        words = BITS // 64
        held = depths(n, percent) * words
        maps = np.zeros((len(n), int(held.max(initial=words))), dtype=np.uint64)
        maps[np.arange(maps.shape[1]) < held[:, None]] = np.frombuffer(raw, dtype=np.uint64)
        return cls(n, levels(n), maps.reshape(len(n), maps.shape[1] // words, words))

    def part(self, rows: slice) -> Mapped:
        return Mapped(self.n[rows], self.level[rows], self.maps[rows])

    def apart(self, i, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differing bits of set ``i`` and ``others`` at the lower level of both, and that level;
        of no meaning where sizes exclude a link."""
        low = np.minimum(self.level[i], self.level[others])
        last = self.maps.shape[1] - 1
        mine = self.maps[i, np.minimum(self.level[i] - low, last)]
        theirs = self.maps[others, np.minimum(self.level[others] - low, last)]
        return np.bitwise_count(mine ^ theirs).sum(axis=-1, dtype=np.int64), low

    def may_link(self, i, others: np.ndarray, percent: int) -> np.ndarray:
        """Whether sizes and the bound on the overlap of set ``i`` with ``others`` admit a link."""
        n = self.n
        both = n[others] + n[i]
        near = 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
        # Elements that are in one of two linked sets only.
        most = both - 2 * -(-both * percent // (100 + percent))
        if not self.level.any():
            differ = np.bitwise_count(self.maps[others, 0] ^ self.maps[i, 0]).sum(axis=-1, dtype=np.int64)
            return near & (differ <= most)
        differ, level = self.apart(i, others)
        # Bernstein's inequality for the number of them that are drawn.
        share = np.ldexp(1.0, -level)
        room = DOUBT / 3 + np.sqrt(DOUBT * DOUBT / 9 + 2 * DOUBT * share * (1 - share) * most)
        return near & (differ <= np.where(level > 0, share * most + room, most))


def run_forest(keys: np.ndarray, sets: Mapped, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what may link among the sets of one signature: a breadth-first search
    in which each set is compared once with those not reached yet."""
    found = []
    left = np.arange(len(keys))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = sets.may_link(i, left, percent)
            if near.any():
                reached = left[near].tolist()
                found += [(int(keys[i]), int(keys[j])) for j in reached]
                queue += reached
                left = left[~near]
    return found


def first_of_runs(marks: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct marks with their least keys, and ``(mark, key, least key)`` for the other keys."""
    order = np.lexsort((keys, marks))
    marks, keys = marks[order], keys[order]
    new = np.concatenate(([True], marks[1:] != marks[:-1]))[: len(marks)]
    head = keys[np.maximum.accumulate(np.where(new, np.arange(len(marks)), 0))]
    other = keys != head
    edges = np.stack((marks[other].view(np.int64), keys[other], head[other]))
    return marks[new], keys[new], np.unique(edges, axis=1)


def sets_and_stars(
    docs: DataFrame, row_id: str, text: str, width: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """Rows ``(row_id, n, k1, k2, bits)`` with the size, key and bitmaps of every set, and
    ``(sig, a, b)``: keys of sets with the same signature, each with the first one of its run.

    One pass over the texts and one shuffle. A task sends each signature once for some thousand
    texts, with the least key that has it, and the edges from the other keys to that one; so a
    signature held by very many sets makes no large group. Signatures, keys and edges travel as
    packed numbers, dealt by the leading bits of the signature.
    """
    rows = docs.select(integer_ids(docs, row_id).alias("row_id"), F.col(text).alias("text"))
    buckets = max(parts(docs.sparkSession), -(-rows.count() // BUCKET_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bands = WordHasher(SPACED), Bands(percent)
        sigs: list[np.ndarray] = []
        keys: list[int] = []
        found: list[tuple] = []
        maps: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            marks = np.concatenate(sigs) if sigs else np.empty(0, np.uint64)
            owner = np.repeat(np.array(keys, dtype=np.int64), [len(x) for x in sigs])
            marks, least, edges = first_of_runs(marks, owner)
            home = ((marks >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(home, np.arange(buckets + 1, dtype=np.uint64))
            table = np.array(found, dtype=np.int64).reshape(-1, 5)
            out = []
            for k, part in enumerate(zip(cuts[:-1], cuts[1:])):
                pairs = np.stack((marks[slice(*part)].view(np.int64), least[slice(*part)]))
                mine = (table[k::buckets], edges[:, k::buckets], pairs)
                if any(x.size for x in mine):
                    out.append((k, *[x.tobytes() for x in mine], b"".join(maps[k::buckets])))
            columns = list(zip(*out)) or [[], [], [], [], []]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "sets", "edges", "pairs", "maps"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, words in zip(ids, hasher.texts(x.as_py() for x in batch.column(1))):
                members = shingle_set(words, width)
                first, second = set_key(members)
                found.append((row is None, row or 0, len(members), first, second))
                maps.append(level_bitmaps(members, percent))
                sigs.append(signatures(members, bands))
                keys.append(first)
                size += len(sigs[-1])
                if size > FLUSH_PAIRS:
                    yield flush()
                    sigs.clear(), keys.clear(), found.clear(), maps.clear()
                    size = 0
        yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = []
        for batch in batches:
            for part in batch.column(3):
                pairs.append(np.frombuffer(part.as_py(), dtype=np.int64).reshape(2, -1))
            for part, maps in zip(batch.column(1), batch.column(4)):
                table = np.frombuffer(part.as_py(), dtype=np.int64).reshape(-1, 5)
                ids = pa.array(table[:, 1], mask=table[:, 0] == 1)
                none = pa.nulls(len(table), pa.int64())
                sets = [pa.array(table[:, i]) for i in (2, 3, 4)]
                raw, ends = maps.as_py(), np.cumsum(depths(table[:, 2], percent) * (BITS // 8)).tolist()
                bits = pa.array([raw[lo:hi] for lo, hi in zip([0, *ends], ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, *sets, bits, none, none, none], names)
            yield edge_batch([np.frombuffer(x.as_py(), dtype=np.int64).reshape(3, -1) for x in batch.column(2)])
        if pairs:
            marks, keys = np.concatenate(pairs, axis=1)
            yield edge_batch([first_of_runs(marks.view(np.uint64), keys)[2]])

    def edge_batch(edges: list[np.ndarray]) -> pa.RecordBatch:
        three = np.concatenate(edges, axis=1) if edges else np.empty((3, 0), np.int64)
        none = pa.nulls(three.shape[1], pa.int64())
        bits = pa.nulls(three.shape[1], pa.binary())
        columns = [none, none, none, none, bits, *map(pa.array, three)]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["row_id", "n", "k1", "k2", "bits", "sig", "a", "b"]
    packed = rows.mapInArrow(deal, "bucket int, sets binary, edges binary, pairs binary, maps binary")
    schema = "row_id long, n long, k1 long, k2 long, bits binary, sig long, a long, b long"
    met = stored(packed.repartition(buckets, "bucket").mapInArrow(meet, schema), "sets-and-stars")
    sets = met.filter(F.col("n").isNotNull()).select("row_id", "n", "k1", "k2", "bits")
    return sets, met.filter(F.col("n").isNull()).select("sig", "a", "b")


def bounded_edges(sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges whose components hold every pair that shares a signature and passes the
    bound of its bitmaps. Sets that share a passage only are told apart here, before any text moves.
    """
    runs = stars.select("sig", F.explode(F.array("a", "b")).alias("k1")).distinct()
    held = sets.select("k1", "n", "bits").dropDuplicates(["k1"])
    marked = runs.join(held, "k1")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs are contiguous; the last one of a batch waits for the next."""
        waiting = []

        def edges(rows: pa.Table) -> pa.RecordBatch:
            sig, n, keys = (np.asarray(rows.column(i).combine_chunks()) for i in (0, 1, 2))
            mapped = Mapped.read(n, b"".join(rows.column(3).to_pylist()), percent)
            starts = np.concatenate(([0], np.flatnonzero(sig[1:] != sig[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(sig)])))
            # Most runs are pairs; they are bounded all at once.
            one = starts[sizes == 2]
            one = one[mapped.may_link(one, one + 1, percent)]
            found = np.stack((keys[one], keys[one + 1]), axis=1).tolist()
            for lo, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                run = slice(lo, lo + m)
                found += run_forest(keys[run], mapped.part(run), percent)
            both = np.unique(np.array(found, dtype=np.int64).reshape(-1, 2), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            sig = np.asarray(batch.column(0))
            last = int(np.searchsorted(sig, sig[-1]))
            if last or (waiting and np.asarray(waiting[0].column(0))[0] != sig[0]):
                waiting.append(batch.slice(0, last))
                yield edges(pa.Table.from_batches(waiting))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield edges(pa.Table.from_batches(waiting))

    ordered = (
        marked.select("sig", "n", "k1", "bits").repartition("sig").sortWithinPartitions("sig", "n", "k1")
    )
    return stored(ordered.mapInArrow(filtered, "a long, b long"), "bounded-edges").distinct()


def tile_links(
    ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Linked pairs that connect everything linked in a tile; equal labels count as connected."""
    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    ids = [ids[i] for i in order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    mapped = Mapped.read(sizes, b"".join(level_bitmaps(s, percent) for s in sets), percent)
    comp = np.unique(np.array([labels[i] for i in order]), return_inverse=True)[1]
    found = []
    for i in range(1, len(ids)):
        lo = int(np.searchsorted(sizes[:i] * 100, sizes[i] * percent))
        other = lo + np.flatnonzero(comp[lo:i] != comp[i])
        if len(other) == 0:
            continue
        other = other[mapped.may_link(i, other, percent)]
        near = other[np.argsort(mapped.apart(i, other)[0], kind="stable")]
        for j in near.tolist():
            if comp[j] == comp[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                found.append((ids[i], ids[j]))
                comp[comp == comp[j]] = comp[i]
    return found


def tile_runner(width: int, percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets, kept = [], []
        rows = rows.drop_duplicates("id", ignore_index=True)
        hasher = WordHasher(SPACED)
        for row, words in enumerate(hasher.texts(rows["text"].tolist())):
            sets.append(shingle_set(words, width))
            kept.append(row)
        links = tile_links(rows["id"].tolist(), rows["label"].tolist(), sets, percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def small_or_shuffled(narrow: DataFrame) -> DataFrame:
    """Marks a stored table of a few numbers a row for broadcasting if its row count allows."""
    return F.broadcast(narrow) if fits_broadcast(narrow) else narrow


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of blocks of their group, and a block by hash."""
    sums = rows.groupBy("group").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)
        ).alias("blocks")
    )
    counted = small_or_shuffled(stored(sums, "group-blocks"))
    return rows.join(counted, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))


def compare(rows: DataFrame, keys: list[str], width: int, percent: int, name: str) -> DataFrame:
    # Dealt by all keys: left to the planner, rows would stay where a join by group had put them.
    tiles = rows.select(*keys, "id", "label", "text").repartition(*keys).groupBy(*keys)
    return stored(tiles.applyInPandas(tile_runner(width, percent), "a long, b long"), name)


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the label of their component over ``links``."""
    comps = stored(components(links, "a", "b").select("id", F.col("root").alias("_root")), "labels")
    return (
        members.drop("label")
        .join(small_or_shuffled(comps), "id", "left")
        .withColumn("label", F.coalesce("_root", "id"))
        .drop("_root")
    )


def group_links(near: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect all linked members of every candidate group.

    ``near`` has ``id, group, n, text`` for each member, one row a member.
    """
    first = dealt(near.withColumn("label", F.col("id")))
    links = compare(first, ["group", "block"], width, percent, "links-in-blocks")
    large = first.filter("blocks > 1").drop("blocks", "block")
    if large.isEmpty():
        return links
    heads = labelled(large, links).filter(F.col("label") == F.col("id"))
    again = compare(dealt(heads), ["group", "block"], width, percent, "links-of-heads")
    links = links.unionByName(again)
    marked = labelled(large, links)
    sizes = marked.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("group").agg(
        F.max(F.struct("c", F.col("label").alias("l"))).alias("top"), F.count(F.lit(1)).alias("k")
    )
    open_groups = main.filter("k > 1").select("group", F.col("top.l").alias("main"))
    rest = marked.join(open_groups, "group").withColumn("inner", F.col("label") == F.col("main"))
    if rest.isEmpty():
        return links
    outer = dealt(rest.filter("not inner"))
    inner = dealt(rest.filter("inner"))
    shape = outer.groupBy("group").agg(F.max("blocks").alias("outer_blocks"))
    shape = shape.join(inner.groupBy("group").agg(F.max("blocks").alias("inner_blocks")), "group")

    def upto(n: str):
        return F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)

    block = F.col("block").cast("long")
    with_inner = F.transform(
        upto("inner_blocks"), lambda j: F.struct(F.lit(1).alias("kind"), block.alias("i"), j.alias("j"))
    )
    with_outer = F.transform(
        upto("outer_blocks"),
        lambda j: F.struct(
            F.lit(0).alias("kind"), F.least(block, j).alias("i"), F.greatest(block, j).alias("j")
        ),
    )
    to_outer = F.transform(
        upto("outer_blocks"), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), block.alias("j"))
    )
    columns = ["group", "id", "label", "text"]
    tiles = (
        outer.join(shape, "group")
        .select(*columns, F.explode(F.concat(with_inner, with_outer)).alias("tile"))
        .unionByName(
            inner.join(shape, "group").select(*columns, F.explode(to_outer).alias("tile"))
        )
        .select(*columns, "tile.kind", "tile.i", "tile.j")
    )
    across = compare(tiles, ["group", "kind", "i", "j"], width, percent, "links-across-blocks")
    return links.unionByName(across)


def jaccard_components(
    docs: DataFrame, row_id: str, text: str, width: int = 3, percent: int = 90
) -> DataFrame:
    """``(row_id, n_shingles, component_id)`` for every row of ``docs``."""
    sets, stars = sets_and_stars(docs, row_id, text, width, percent)
    filled = sets.filter("n > 0")
    edges = bounded_edges(filled, stars, percent)
    comps = components(edges, "a", "b")
    roots = comps.select(F.col("root").alias("k1"), F.col("root").alias("group")).distinct()
    groups = comps.select(F.col("id").alias("k1"), F.col("root").alias("group")).unionByName(roots)
    classes = stored(
        filled.groupBy("k1", "k2", "n").agg(F.min("row_id").alias("id")), "equal-sets"
    )
    members = classes.filter(F.col("id").isNotNull()).join(groups, "k1").select("id", "group", "n", "k1")
    rows = docs.select(integer_ids(docs, row_id).alias("id"), F.col(text).alias("text"))
    near = stored(rows.join(small_or_shuffled(stored(members, "candidates")), "id"), "candidate-texts")
    links = group_links(near, width, percent)
    found = components(links, "a", "b").select("id", F.col("root").alias("component_id"))
    named = classes.join(found, "id", "left").select(
        "k1", "k2", "n", F.coalesce("component_id", "id").alias("component_id")
    )
    linked = filled.select("row_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"]).select(
        "row_id", F.col("n").alias("n_shingles"), "component_id"
    )
    empty = sets.filter("n = 0").select(
        "row_id", F.col("n").alias("n_shingles"), F.col("row_id").alias("component_id")
    )
    return linked.unionByName(empty)
