"""Words of whole texts as 64-bit hashes, computed on blocks of bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

# Bytes hashed at a time: bounds the working arrays, not the text.
BLOCK_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Lower-cased bytes with every separator as a blank: white space only, or all but a-z, 0-9 and
# the bytes of code points above 127.
SPACED = bytes(32 if b in b" \t\n\r\x0b\x0c" else LOWER[b] for b in range(256))
ALNUM = bytes(
    LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on 64 bits (the one of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` of small numbers spread by an odd factor first, in place to save memory."""
    x *= BASE
    high = np.empty_like(x)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1):
        np.right_shift(x, np.uint64(33), out=high)
        x ^= high
        x *= np.uint64(factor)
    return x


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class WordHasher:
    """Hashes of the blank-separated words of some bytes.

    A word's hash is the sum of one mixed number for each of its bytes and places, mixed with its
    length. Unlike a polynomial mod 2^64 no family of words collides whatever the base.
    """

    def __init__(self, table: bytes = SPACED, heads: Sequence[int] = ()):
        """With ``heads``, hashes have a row for the words and one for their first bytes."""
        self.table = table
        self.heads = tuple(heads)

    def block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start offsets and hashes of the words of ``raw``, already translated."""
        data = np.frombuffer(raw, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (data != 32).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        # The place of every byte in its word; blanks go on counting and belong to no span.
        place = np.arange(len(data), dtype=np.uint64)
        if len(starts):
            size = np.diff(np.append(starts, len(data)))
            place[starts[0] :] -= np.repeat(starts.astype(np.uint64), size)
        place <<= np.uint64(8)
        place |= data
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(mixed(place), out=total[1:])
        whole = self.spans(total, starts, ends)
        if not self.heads:
            return starts, whole
        rows = [whole]
        for size in self.heads:
            stop = np.minimum(starts + size, ends)
            rows.append(np.where(stop < ends, ~self.spans(total, starts, stop), whole))
        return starts, np.stack(rows)

    def spans(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(total[ends] - total[starts] + mix((ends - starts).astype(np.uint64)))

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Like ``block`` for any length: blocks end at blanks, so no word is cut."""
        raw = raw.translate(self.table)
        if len(raw) <= BLOCK_BYTES:
            return self.block(raw)
        starts, hashes, lo = [], [], 0
        while lo < len(raw):
            hi = len(raw)
            if hi - lo > BLOCK_BYTES:
                hi = raw.rfind(b" ", lo, lo + BLOCK_BYTES) + 1
                if hi <= lo:
                    hi = (raw.find(b" ", lo + BLOCK_BYTES) + 1) or len(raw)
            s, h = self.block(raw[lo:hi])
            starts.append(s + lo)
            hashes.append(h)
            lo = hi
        return np.concatenate(starts), np.concatenate(hashes, axis=-1)

    def texts(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Word hashes of each text in order; short texts share a block."""
        waiting: list[bytes] = []
        size = 0
        for text in texts:
            waiting.append(as_bytes(text))
            size += len(waiting[-1]) + 1
            if size >= BLOCK_BYTES:
                yield from self.together(waiting)
                waiting, size = [], 0
        yield from self.together(waiting)

    def together(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        if not raws:
            return
        starts, hashes = self.words(b"\n".join(raws))
        bounds = np.cumsum([len(r) + 1 for r in raws])
        at = 0
        for end in np.searchsorted(starts, bounds):
            yield hashes[..., at:end]
            at = end


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive words in order; a shorter text is one shingle."""
    if len(words) == 0:
        return words
    if len(words) < width:
        width = len(words)
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        out = mix(out + words[j : j + n])
    return out
