"""Operator 12: periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period ``q`` and at least ``max(least, 2 * q)`` words that
no neighbouring word extends with that period. All runs of a text are found, exactly:

1. Names. Words become numbers, and stretches of 2, 4, 8, ... words get a number each by naming
   pairs of numbers, so equal numbers mean equal words (no hashing). Naming ends at the first length
   that no stretch repeats; most texts end after a few.
2. Short periods, up to ``2 ** FIRST - 1``: one comparison of the words with themselves for each lag.
3. Scale ``k`` covers periods from ``2 ** k`` to ``2 ** (k + 1) - 1``. Grams and windows have
   ``2 ** (k - 1)`` of length, so a run holds a whole window and its copy one period later, and the
   window's least gram stands at the same place in both. Every two equal minimizers at such a
   distance are a seed. Equal grams that are not periodic themselves lie more than half a gram apart,
   so a minimizer has at most eight partners.
4. Grams inside a run of a period up to half a gram are no minimizers. A run that has no other ones
   consists of two touching stretches of the same small period; their periods are seeds by phase.
5. Seeds are extended both ways by binary steps over the names. Stretches of multiples of a period
   end where the run of the period ends, so the least period of each stretch remains.

Short texts share a block, with a word of its own between two texts. ``BLOCK_WORDS`` bounds the block,
not the text; memory is in proportion to the longest text.

Defined results: null and empty texts and texts of blanks have no words, no run and the digests of the
empty string; a row with a null id has its text searched unchanged; repeated rows stay; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.llm.words import mix

LEAST = 12
# The first scale: shorter periods are compared lag by lag.
FIRST = 4
BLOCK_WORDS = 1 << 17
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def name_pairs(names: np.ndarray, span: int) -> tuple[np.ndarray, bool]:
    """Names of stretches of ``2 * span`` words, and whether any of them repeats."""
    left, right = names[:-span], names[span:]
    both = left.astype(np.int64) * (int(right.max()) + 1) + right
    known, found = np.unique(both, return_inverse=True)
    return found.astype(np.int32), len(known) < len(both)


def all_names(words: np.ndarray) -> list[np.ndarray]:
    """Names of stretches of 1, 2, 4, ... words, while any stretch of that length repeats."""
    levels, span = [words], 1
    while len(levels[-1]) > span:
        names, repeats = name_pairs(levels[-1], span)
        if not repeats:
            break
        levels.append(names)
        span *= 2
    return levels


def lag_stretches(words: np.ndarray, lag: int, least: int) -> np.ndarray:
    """``(start, end)`` of the longest stretches of period ``lag`` and at least ``least`` words."""
    same = words[:-lag] == words[lag:]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2] + lag
    return np.stack((starts, ends))[:, ends - starts >= max(least, 2 * lag)]


def extended(levels: list[np.ndarray], at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch of period ``lag`` around ``at``, where the word repeats."""
    right, left = at.copy(), at.copy()
    for level in range(len(levels) - 1, -1, -1):
        names, span = levels[level], 1 << level
        # Names end at the first length without repeats, so the longest step may be needed again.
        while True:
            fits = right + lag < len(names)
            fits[fits] = names[right[fits]] == names[(right + lag)[fits]]
            right[fits] += span
            if level < len(levels) - 1 or not fits.any():
                break
        while True:
            fits = left >= span
            fits[fits] = names[left[fits] - span] == names[(left + lag)[fits] - span]
            left[fits] -= span
            if level < len(levels) - 1 or not fits.any():
                break
    return left, right + lag


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values; ``width`` is a power of two."""
    span, out = 1, values
    while span < width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out


def minimizers(names: np.ndarray, plain: np.ndarray, width: int) -> np.ndarray:
    """Places of the grams that are least in some window of ``width``, of those marked ``plain``."""
    if len(names) < width or not plain.any():
        return np.empty(0, np.int64)
    order = np.where(plain, mix(names.astype(np.uint64)), NEVER)
    lows = window_least(order, width)
    # The largest minimum of the windows that hold a place is its own value if it is least in one.
    rim = np.zeros(width - 1, np.uint64)
    most = ~window_least(~np.concatenate((rim, lows, rim)), width)
    return np.flatnonzero(plain & (most == order))


def minimizer_seeds(names: np.ndarray, places: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, distance)`` of equal minimizers ``low`` to ``2 * low - 1`` words apart."""
    order = np.argsort(names[places], kind="stable")
    spots = places[order]
    keys = names[spots]
    at, lag, step = [], [], 1
    while step < len(spots):
        apart = spots[step:] - spots[:-step]
        near = (keys[step:] == keys[:-step]) & (apart < 2 * low)
        if not near.any():
            break
        pick = np.flatnonzero(near & (apart >= low))
        at.append(spots[pick])
        lag.append(apart[pick])
        step += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *lag])


def touching_seeds(names: np.ndarray, runs: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds between two touching stretches of the same small period and the same words.

    ``runs`` has ``start, end, period`` of runs at least ``low`` long.
    """
    order = np.lexsort((runs[0], runs[2]))
    starts, ends, periods = runs[:, order]
    pair = np.flatnonzero((periods[1:] == periods[:-1]) & (starts[1:] <= ends[:-1]))
    at, lag = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in pair.tolist():
        a1, b1, q = int(starts[i]), int(ends[i]), int(periods[i])
        a2, b2 = int(starts[i + 1]), int(ends[i + 1])
        phase = np.flatnonzero(names[a1 : a1 + q] == names[a2])
        if len(phase) == 0:
            continue
        first = a2 - a1 - int(phase[0])
        tries = np.arange(low + (first - low) % q, 2 * low, q)
        begin = np.maximum(a1, a2 - tries)
        fits = begin < np.minimum(b1, b2 - tries)
        at.append(begin[fits])
        lag.append(tries[fits])
    return np.concatenate(at), np.concatenate(lag)


def least_periods(found: np.ndarray) -> np.ndarray:
    """Each stretch ``start, end, period`` once, with its least period, by start and period."""
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
    found = found[:, new]
    return found[:, np.lexsort((found[2], found[0]))]


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``start, end, period`` (three rows) of all runs of an array of word numbers."""
    found = [np.empty((3, 0), np.int64)]
    # Small stretches count as periodic grams of the first scale even below ``least`` words.
    short = min(least, 1 << (FIRST - 1))
    for lag in range(1, min(1 << FIRST, len(words))):
        ends = lag_stretches(words, lag, short)
        found.append(np.vstack((ends, np.full((1, ends.shape[1]), lag))))
    runs = least_periods(np.concatenate(found, axis=1))
    levels, scale = None, FIRST
    while 2 << scale <= len(words):
        if levels is None:
            levels = all_names(words)
        if scale - 1 >= len(levels):
            break
        names, gram, low = levels[scale - 1], 1 << (scale - 1), 1 << scale
        inside = runs[:, (runs[2] <= gram // 2) & (runs[1] - runs[0] >= gram)]
        depth = np.zeros(len(names) + 1, np.int64)
        np.add.at(depth, inside[0], 1)
        np.add.at(depth, inside[1] - gram + 1, -1)
        repeated = np.bincount(names)[names] > 1
        plain = repeated & (np.cumsum(depth[:-1]) == 0)
        seeds = minimizer_seeds(names, minimizers(names, plain, gram), low)
        long = inside[:, inside[1] - inside[0] >= low]
        more = touching_seeds(names, long, low)
        at, lag = (np.concatenate(x) for x in zip(seeds, more))
        if len(at):
            starts, ends = extended(levels, at, lag)
            whole = ends - starts >= 2 * lag
            runs = least_periods(np.hstack((runs, np.stack((starts, ends, lag))[:, whole])))
        scale += 1
    return runs[:, runs[1] - runs[0] >= np.maximum(least, 2 * runs[2])]


def planted_order(key: object, n: int) -> np.ndarray | None:
    """Places of the words of a text of ``n`` after the edit the contract plants, if it has one."""
    if key is None or n == 0:
        return None
    mark = zlib.crc32(str(key).encode())
    if mark % 10:
        return None
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


Edit = Callable[[object, int], "np.ndarray | None"]
COLUMNS = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
)


def block_rows(texts: list[list[bytes]], least: int) -> Iterator[tuple]:
    """Values of ``COLUMNS`` for each list of words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    numbers = np.asarray(flat.indices, dtype=np.int32)
    # A word of its own ends each text, so no run crosses texts.
    first = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(len(numbers) + len(texts), np.int32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    words[np.arange(len(numbers)) + owner] = numbers
    words[first + sizes] = len(flat.dictionary) + np.arange(len(texts))
    runs = find_runs(words, least)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[0] + runs[2], 1)
    np.add.at(depth, runs[1], -1)
    kept = np.cumsum(depth) == 0
    cuts = np.searchsorted(runs[0], np.append(first, len(words)))
    for i, text in enumerate(texts):
        s, e, q = runs[:, cuts[i] : cuts[i + 1]]
        if len(s) == 0:
            yield 0, None, None, None, None, sha(b""), sha(b" ".join(text)), []
            continue
        s = s - first[i]
        size = e - first[i] - s
        top = np.lexsort((q, s, -size))[0]
        listed = list(zip(s.tolist(), size.tolist(), q.tolist()))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in listed)
        rest = [text[j] for j in np.flatnonzero(kept[first[i] : first[i] + sizes[i]]).tolist()]
        start, length, period = listed[top]
        shown = [{"start": a, "length": b, "period": c} for a, b, c in listed]
        milli = 1000 * length // period
        digests = sha(lines.encode()), sha(b" ".join(rest))
        yield len(s), start, length, period, milli, *digests, shown


def periodic_runs(
    docs: DataFrame, row_id: str, text: str, least: int = LEAST, edit: Edit | None = None
) -> DataFrame:
    """``row_id`` and ``COLUMNS`` for every row: the number of runs, the longest one, digests of all
    runs and of the text without repeated periods, and the runs. ``edit(id, n)`` may give an order
    of the words to search instead of the text's own.
    """
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["row_id"].dataType.simpleString()
    runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [runs]
    names = ["row_id", *(c.strip().split(" ")[0] for c in COLUMNS.split(", "))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, waiting, size, lo = batch.column(1), [], 0, 0
            for i in range(batch.num_rows):
                words = (raw[i].as_py() or b"").split()
                order = edit(batch.column(0)[i].as_py(), len(words)) if edit else None
                waiting.append(words if order is None else [words[j] for j in order.tolist()])
                size += len(words)
                if size >= BLOCK_WORDS or i + 1 == batch.num_rows:
                    columns = zip(*block_rows(waiting, least))
                    values = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
                    ids = batch.column(0).slice(lo, len(waiting))
                    yield pa.RecordBatch.from_arrays([ids, *values], names)
                    waiting, size, lo = [], 0, i + 1

    return rows.mapInArrow(search, f"row_id {kind}, {COLUMNS}")
