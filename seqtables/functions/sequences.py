"""Sequence checks, cleaning, truncation and windows (row-local expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.annotations import strip
from seqtables.functions.common import bind


def is_valid_sequence(
    col: Column,
    alphabet: str = P.RESIDUES,
    min_length: int = P.MIN_LENGTH,
    max_length: int = P.MAX_LENGTH,
) -> Column:
    """Length within the bounds and only residue letters (plus X and U), any case."""
    foreign = f"[^{alphabet}{P.EXTRA_RESIDUES}]"
    # Bound once: a filter is pushed below the projection that derives the sequence.
    ok = bind(
        F.upper(col),
        lambda s: F.length(s).between(max(1, min_length), max_length) & ~s.rlike(foreign),
    )
    return F.coalesce(ok, F.lit(False))


def has_nonstandard(col: Column, alphabet: str = P.RESIDUES) -> Column:
    """The raw profile counts X and U as non-standard too."""
    return F.coalesce(F.upper(col).rlike(f"[^{alphabet}]"), F.lit(False))


def clean_sequence(col: Column, alphabet: str = P.RESIDUES) -> Column:
    return F.regexp_replace(F.upper(col), f"[^{alphabet}]", "")


def truncate(col: Column, max_length: int, backbone_max: int = 1024) -> Column:
    """Cut to the smaller bound, which includes the two special positions."""
    return F.substring(col, 1, max(0, min(max_length, backbone_max) - 2))


def request_error(
    col: Column,
    alphabet: str = P.RESIDUES,
    min_length: int = 10,
    max_length: int = 5000,
    batch_max: int | None = P.MAX_LENGTH,
) -> Column:
    """Why a scoring request is refused, or null when it is accepted.

    Lengths are those of the text as sent; letters are checked after strip and upper.
    """
    pattern = f"^[{alphabet}{P.EXTRA_RESIDUES}]+$"

    def check(text: Column) -> Column:
        case = (
            F.when(text.isNull(), "missing")
            .when(F.length(text) < min_length, "too_short")
            .when(F.length(text) > max_length, "too_long")
            .when(~F.upper(strip(text)).rlike(pattern), "invalid_residues")
        )
        if batch_max is not None:
            case = case.when(F.length(strip(text)) > batch_max, "too_long_for_batch")
        return case

    return bind(col, check)


def normalize_request(col: Column) -> Column:
    return F.upper(strip(col))


def chunk_sequence(
    col: Column, window: int, overlap: int, min_chunk: int | None = None
) -> Column:
    """Overlapping windows; the last one is the first that reaches the end of the sequence."""
    if window < 1:
        raise ValueError("window must be positive")
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and below window")
    shortest = max(1, window // 4) if min_chunk is None else min_chunk
    stride = window - overlap
    rest = F.greatest(F.lit(0), F.length(col) - window)
    steps = F.floor((rest + (stride - 1)) / stride).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), steps), lambda i: F.substring(col, i * stride + 1, F.lit(window))
    )
    return F.when(F.length(col) <= window, F.array(col)).otherwise(
        F.filter(cut, lambda c: F.length(c) >= shortest)
    )
