"""Operator 7: best-fit packing by bin completion on the histogram of piece lengths.

Documents become token pieces of at most ``capacity``; whoever is longer is cut, its first piece
taking the remainder. Pieces of one length are interchangeable, so the search sees only the number
of pieces of each length, at most ``capacity`` numbers however many documents there are. Bin
completion (Korf 2002) takes the largest length left, enumerates undominated fillings of the rest
of its sequence, least waste first, and applies each to as many sequences as the counts and the
waste still allowed permit, or to one.
The best-fit decreasing packing is the first incumbent; a branch whose sequences so far and lower
bound (Martello and Toth's L2, which bounds the waste) reach the incumbent is pruned. The search
ends at the lower bound or after ``MAX_STEPS`` fillings, with the best packing found.

The plan, one row for each pattern and place, is joined back to the pieces by length and rank.

Defined results: a null text is the empty text, whose only token is the end token; equal rows are
separate pieces; an empty table gives no pieces; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.llm.tables import stored
from seqtables.operators.ranking import grouped_row_number

CAPACITY = 1024
END_ID = 2
MAX_STEPS = 6_000
# Fillings kept at a branch, and items placed in search of them.
MAX_FILLINGS = 12
MAX_NODES = 600
# Chunks of text whose ids a worker remembers, in each of two generations.
MEMORY = 220_000
# Texts whose new chunks are encoded together.
TOGETHER = 64
# New chunks encoded as one text. The tokenizer takes longer for a chunk in long texts.
SIDE_BY_SIDE = 32


def unsafe(chunk: str) -> bool:
    """Whether a text with this chunk between blanks may not be encoded by chunks: a blank after white
    space or at an end, or what may begin a special token."""
    return not chunk or chunk[-1].isspace() or "<|" in chunk


class ChunkEncoder:
    """Ids of texts by a byte-level tokenizer file, with repeated chunks encoded once.

    Such a tokenizer, without a normalizer, never joins a character and a blank after it, so a text
    is the concatenation of its chunks cut before single blanks. Texts where a blank follows other
    white space, or that may hold a special token, are encoded whole.
    """

    def __init__(self, tokenizer: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(tokenizer)
        # A token of the vocabulary is written with one character for each byte.
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.size[number] = len(token)
        # Ids by chunk without its blank, None for unsafe ones.
        self.memory: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return np.array(self.encoded([text])[0], dtype="<u4").tobytes()

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; new chunks of some texts are learnt at once."""
        for lo in range(0, len(texts), TOGETHER):
            part = [text or "" for text in texts[lo : lo + TOGETHER]]
            cut = [text.split(" ") for text in part]
            new: set[str] = set()
            for chunks in cut:
                new.update(chunks[1:])
            new = new.difference(self.memory)
            if new:
                self.recall(new)
            # The first chunks have no blank before them.
            heads = self.encoded([chunks[0] for chunks in cut])
            known = self.memory.__getitem__
            for text, chunks, head in zip(part, cut, heads):
                ids = [np.array(head, dtype="<u4").tobytes(), *map(known, chunks[1:])]
                if unsafe(chunks[0]) or None in ids:
                    yield self.whole(text)
                else:
                    yield b"".join(ids)
            if len(self.memory) > MEMORY:
                self.older, self.memory = self.memory, {}

    def recall(self, chunks: set[str]) -> None:
        """Chunks of the older generation move on to the present one, others are encoded."""
        known = chunks & self.older.keys()
        self.memory.update((c, self.older[c]) for c in known)
        self.learn(list(chunks - known))

    def learn(self, chunks: list[str]) -> None:
        """Encodes new chunks side by side and cuts the ids where a chunk begins."""
        safe = [c for c in chunks if not unsafe(c)]
        self.memory.update(dict.fromkeys(chunks))
        if safe:
            texts = [
                " " + " ".join(safe[lo : lo + SIDE_BY_SIDE]) for lo in range(0, len(safe), SIDE_BY_SIDE)
            ]
            ids = np.fromiter(chain.from_iterable(self.encoded(texts)), dtype="<u4")
            raw = ids.tobytes()
            ends = np.cumsum(self.size[ids])
            blanks = np.flatnonzero(np.frombuffer("".join(texts).encode(), dtype=np.uint8) == 32)
            cuts = [*(4 * np.searchsorted(ends, blanks, side="right")).tolist(), len(raw)]
            self.memory.update({c: raw[lo:hi] for c, lo, hi in zip(safe, cuts, cuts[1:])})


def shared_encoder(sent: Broadcast) -> ChunkEncoder:
    """One encoder for the tasks of a worker, which run one after the other.

    A worker keeps the broadcast object as long as tasks use it, so what was learnt stays there and goes with it.
    """
    if "encoder" not in vars(sent):
        sent.encoder = ChunkEncoder(sent.value)
    return sent.encoder


def cut_pieces(
    docs: DataFrame,
    row_id: str,
    text: str,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """``(row_id, piece, start, length, ids_crc32[, ids])``: one row for each piece."""
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    kind = rows.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" * keep_ids

    # The file travels with the tasks; executors need not have it.
    with open(tokenizer, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(sent)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, raw in enumerate(encoder.batch(batch.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                lo, hi = 0, n % capacity or capacity
                number = 0
                while lo < n:
                    part = raw[4 * lo : 4 * hi]
                    at.append(row)
                    piece.append(number)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
                    lo, hi, number = hi, hi + capacity, number + 1
            columns = [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["row_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(cut, schema)


def lower_bound(counts: np.ndarray) -> int:
    """L2 of Martello and Toth over counts by size: no packing needs fewer bins."""
    capacity = len(counts) - 1
    half = capacity // 2
    number = np.concatenate((np.cumsum(counts[::-1])[::-1], [0]))
    weight = np.concatenate((np.cumsum((counts * np.arange(capacity + 1))[::-1])[::-1], [0]))
    small = np.arange(half + 1)
    alone = number[capacity - small + 1]
    large = number[half + 1] - alone
    room = large * capacity - (weight[half + 1] - weight[capacity - small + 1])
    rest = weight[small] - weight[half + 1]
    more = np.maximum(0, -(-(rest - room) // capacity))
    return int((alone + large + more).max())


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts by size, as patterns with their numbers."""
    capacity = len(counts) - 1
    free: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        room = size
        while left:
            while room < capacity and not free[room]:
                room += 1
            if free[room]:
                pattern, n = free[room].popitem()
            else:
                pattern, n = (), left
                room = capacity
            used = min(n, left)
            if n > used:
                free[room][pattern] = n - used
            grown = (*pattern, size)
            after = room - size
            free[after][grown] = free[after].get(grown, 0) + used
            left -= used
            room = size
    return [(p, n) for bins in free for p, n in bins.items()]


def reachable(sizes: list[int], gap: int) -> list[int]:
    """For each place, the sums up to ``gap`` of any number of the sizes up to there, as bits."""
    sums, bits, mask = [], 1, (1 << (gap + 1)) - 1
    for size in sizes:
        shift = size
        while shift <= gap:
            bits |= (bits << shift) & mask
            shift *= 2
        sums.append(bits)
    return sums


def fillings(counts: np.ndarray, gap: int, waste: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``gap`` that waste at most ``waste``, least waste first.

    A single item that fills the gap dominates all. Otherwise a set whose sum is at most the
    largest single item that fits is dominated by that item, so only larger sums are kept, and a
    filling that leaves room for another item is dominated by that with the item. A branch is left
    when no sum of the sizes it may still use, even without regard to their numbers, wastes so little.
    The limit rises from the least waste any sum allows, so tight fillings are found first.
    """
    sizes = np.flatnonzero(counts[: gap + 1])
    fit = sizes[sizes > 0].tolist()
    if not fit:
        return [()] if gap <= waste else []
    single = fit[-1]
    if single == gap:
        return [(single,)]
    have = counts.tolist()
    sums = reachable(fit, gap)
    found: dict[tuple[int, ...], int] = {}
    nodes = MAX_NODES

    def least(room: int, k: int) -> int:
        return room - (sums[k] & ((2 << room) - 1)).bit_length() + 1

    def extend(chosen: tuple[int, ...], room: int, k: int, limit: int) -> None:
        """Depth first, larger items first."""
        nonlocal nodes
        for i in range(k, -1, -1):
            size = fit[i]
            if size > room or have[size] <= chosen.count(size):
                continue
            if nodes <= 0 or len(found) >= MAX_FILLINGS:
                return
            left = room - size
            if least(left, i) > limit:
                continue
            nodes -= 1
            grown = (*chosen, size)
            if left <= limit and (len(grown) == 1 or gap - left > single):
                others = fit[: bisect_right(fit, left)]
                if all(have[s] <= grown.count(s) for s in others):
                    found[grown] = left
            if left:
                extend(grown, left, i, limit)

    most = min(waste, gap - single)
    limit = least(gap, len(fit) - 1)
    while limit <= most:
        extend((), gap, len(fit) - 1, limit)
        if nodes <= 0 or len(found) >= MAX_FILLINGS or limit == most:
            break
        limit = min(most, 2 * limit + 1)
    if gap - single <= waste:
        found[(single,)] = gap - single
    return sorted(found, key=lambda f: (found[f], len(f), [-x for x in f]))


def branches(state: np.ndarray, slack: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns around the largest piece with the times to use them: as often as the pieces and the
    slack allow, then once, so that a branch may also mix patterns."""
    capacity = len(state) - 1
    largest = int(np.flatnonzero(state)[-1])
    rest = state.copy()
    rest[largest] -= 1
    often, once = [], []
    for filling in fillings(rest, capacity - largest, slack):
        pattern = (largest, *filling)
        need = np.bincount(pattern, minlength=len(state))
        held = np.flatnonzero(need)
        times = int((state[held] // need[held]).min())
        lost = capacity - sum(pattern)
        if lost:
            times = min(times, slack // lost)
        often.append((pattern, times))
        if times > 1:
            once.append((pattern, 1))
    return often + once


def plan_packing(counts: np.ndarray, steps: int = MAX_STEPS):
    """``(patterns with their numbers, lower bound)`` for pieces counted by length.

    Depth-first branch and bound from the best-fit packing. The slack is the room that a packing
    with one sequence less than the best one may waste from here on; it bounds every filling.
    """
    incumbent = best_fit(counts)
    best = sum(n for _, n in incumbent)
    bound = lower_bound(counts)
    capacity = len(counts) - 1
    weights = np.arange(capacity + 1)
    stack = []
    state, used, path = counts.astype(np.int64).copy(), 0, []
    options = None
    while steps > 0 and best > bound:
        if options is None:
            if not state.any():
                if used < best:
                    best, incumbent = used, list(path)
                options = []
            elif used + lower_bound(state) >= best:
                options = []
            else:
                options = branches(state, (best - 1 - used) * capacity - int(state @ weights))
        if not options:
            if not stack:
                break
            state, used, path, options = stack.pop()
            continue
        (pattern, times), *others = options
        if others:
            stack.append((state.copy(), used, list(path), others))
        np.subtract.at(state, list(pattern), times)
        used += times
        path.append((pattern, times))
        options = None
        steps -= 1
    return incumbent, bound


def plan_rows(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, end rank, first sequence, offset)`` of every place of a pattern."""
    rows, taken, base = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            lo = taken.get(size, 0)
            taken[size] = lo + times
            rows.append((size, lo, lo + times, base, offset))
            offset += size
        base += times
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, steps: int = MAX_STEPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the number of sequences is minimised."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    patterns, _ = plan_packing(counts, steps)
    plan = pieces.sparkSession.createDataFrame(
        plan_rows(patterns), "length long, lo long, hi long, base long, offset long"
    )
    order = ["row_id", "piece", "ids_crc32"]
    ranked = grouped_row_number(pieces, ["length"], order, "_rank").alias("p")
    # A plan has at most as many rows as lengths times a few, whatever the number of pieces.
    at = F.col("p._rank")
    plan = F.broadcast(plan.alias("q"))
    match = (F.col("p.length") == F.col("q.length")) & (at >= F.col("q.lo")) & (at < F.col("q.hi"))
    return ranked.join(plan, match).select(
        *[f"p.{c}" for c in pieces.columns],
        (F.col("q.base") + at - F.col("q.lo")).alias("sequence_id"),
        F.col("q.offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, row_id: str, text: str, tokenizer: str, **options) -> DataFrame:
    pieces = stored(cut_pieces(docs, row_id, text, tokenizer, **options), "token-pieces")
    return pack_pieces(pieces, options.get("capacity", CAPACITY))
