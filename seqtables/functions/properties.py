"""Numeric sequence properties as native expressions over residue counts.

The text is cleaned and counted once per row (:func:`with_residue_counts`); properties only read
the counts. Hydropathy sums are kept in whole tenths, so comparisons against cut-offs are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtables import params as P
from seqtables.functions.common import bind
from seqtables.functions.sequences import clean_sequence

NAN = float("nan")
SHORTEST = 5


def residue_count(col: Column, residue: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(residue), F.lit("")))


CLEAN = "_clean"


def n_of(residue: str) -> Column:
    """Count column of a residue, see :func:`with_residue_counts`."""
    return F.col(f"_n_{residue}")


def with_residue_counts(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Add ``_clean`` and one count column per residue.

    They are columns of their own, so every property reads them instead of the text.
    """
    cleaned = df.withColumn(CLEAN, clean_sequence(F.col(sequence)))
    return cleaned.withColumns(
        {f"_n_{a}": residue_count(F.col(CLEAN), a) for a in P.RESIDUES}
    )


def _length() -> Column:
    return F.length(CLEAN)


def weighted_count(weights: Mapping[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [n_of(a) * F.lit(w) for a, w in weights.items()])


def set_fraction(residues: str) -> Column:
    return reduce(lambda a, b: a + b, [n_of(a) for a in residues]) / _length()


def molecular_weight() -> Column:
    return weighted_count(P.RESIDUE_MASS) - (_length() - 1) * F.lit(P.WATER_MASS)


def _tenths(scale: Mapping[str, float]) -> dict[str, int]:
    return {a: round(v * 10) for a, v in scale.items()}


def gravy() -> Column:
    return weighted_count(_tenths(P.HYDROPATHY)) / F.lit(10.0) / _length()


def _terminal_pk(residue: Column, table: Mapping[str, float], default: float) -> Column:
    case = None
    for a, pk in table.items():
        case = F.when(residue == a, pk) if case is None else case.when(residue == a, pk)
    return case.otherwise(F.lit(default))


def charge_groups() -> Column:
    """Counts and terminal pK values the net charge depends on, as one struct."""
    return F.struct(
        *[n_of(a).alias(a) for a in (*P.PK_POSITIVE, *P.PK_NEGATIVE)],
        _terminal_pk(F.left(F.col(CLEAN), F.lit(1)), P.PK_N_TERM, P.PK_N_TERM_DEFAULT).alias(
            "n_term"
        ),
        _terminal_pk(F.right(F.col(CLEAN), F.lit(1)), P.PK_C_TERM, P.PK_C_TERM_DEFAULT).alias(
            "c_term"
        ),
    )


def net_charge(groups: Column, ph: Column) -> Column:
    """Henderson-Hasselbalch over the charged residues and both termini."""

    def gain(pk: Column) -> Column:
        return F.lit(1.0) / (F.pow(F.lit(10.0), ph - pk) + 1.0)

    def loss(pk: Column) -> Column:
        return F.lit(1.0) / (F.pow(F.lit(10.0), pk - ph) + 1.0)

    plus = gain(groups["n_term"])
    for a, pk in P.PK_POSITIVE.items():
        plus = plus + groups[a] * gain(F.lit(pk))
    minus = loss(groups["c_term"])
    for a, pk in P.PK_NEGATIVE.items():
        minus = minus + groups[a] * loss(F.lit(pk))
    return plus - minus


def charge_at_ph7() -> Column:
    return net_charge(charge_groups(), F.lit(7.0))


def isoelectric_point(halvings: int = 17) -> Column:
    """pH of zero net charge; 17 halvings of the bracket leave less than 1e-4."""
    low, high = P.PH_BRACKET

    def step(acc: Column, groups: Column) -> Column:
        return bind(
            (acc["lo"] + acc["hi"]) / 2,
            lambda mid: bind(
                net_charge(groups, mid) > 0,
                lambda positive: F.struct(
                    F.when(positive, mid).otherwise(acc["lo"]).alias("lo"),
                    F.when(positive, acc["hi"]).otherwise(mid).alias("hi"),
                ),
            ),
        )

    return F.aggregate(
        F.array_repeat(charge_groups(), halvings),
        F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")),
        step,
        lambda acc: (acc["lo"] + acc["hi"]) / 2,
    )


def residue_codes(text: str) -> np.ndarray:
    """Position of every letter in the residue alphabet; other letters get its length."""
    table = np.full(256, len(P.RESIDUES), dtype=np.int64)
    for i, a in enumerate(P.RESIDUES):
        table[[ord(a), ord(a.lower())]] = i
    return table[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]


def instability_index(
    dipeptide_weights: Mapping[str, float], default: float = 1.0
) -> Column:
    """10/L times the summed weight of neighbouring residues.

    The published dipeptide weights are passed in; pairs not given weigh ``default``. Neighbours
    are looked up in Arrow batches.
    """
    weights = np.array(
        [[float(dipeptide_weights.get(a + b, default)) for b in P.RESIDUES] for a in P.RESIDUES]
    )

    @F.pandas_udf("double")
    def summed(batch: pd.Series) -> pd.Series:
        def one(text: str | None) -> float:
            codes = residue_codes(text or "")
            # Summed from left to right, as a loop over the sequence would.
            steps = np.cumsum(weights[codes[:-1], codes[1:]])
            return float(steps[-1]) if len(steps) else 0.0

        return batch.map(one).astype("float64")

    return F.lit(10.0) / _length() * summed(F.col(CLEAN))


PROPERTIES: dict[str, Callable[[], Column]] = {
    "molecular_weight": molecular_weight,
    "isoelectric_point": isoelectric_point,
    "gravy": gravy,
    "aromaticity": lambda: set_fraction(P.AROMATIC),
    "charge_at_ph7": charge_at_ph7,
    "helix_fraction": lambda: set_fraction(P.HELIX),
    "turn_fraction": lambda: set_fraction(P.TURN),
    "sheet_fraction": lambda: set_fraction(P.SHEET),
    "sequence_length": lambda: _length().cast("double"),
}


def sequence_properties(
    df: DataFrame,
    sequence: str = "sequence",
    names: Sequence[str] | None = None,
    dipeptide_weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Add one column per property; NaN below five residues and for unknown names.

    Without ``names`` it is the default list, with the instability index only if the published
    dipeptide weights are given: they are a parameter, not part of the library.
    """
    if names is None:
        without = () if dipeptide_weights else ("instability_index",)
        names = [n for n in P.DEFAULT_PROPERTIES if n not in without]

    def value(name: str) -> Column:
        if name == "instability_index":
            if dipeptide_weights is None:
                raise ValueError("instability_index needs the dipeptide weight table")
            found = instability_index(dipeptide_weights)
        elif name in PROPERTIES:
            found = PROPERTIES[name]()
        else:
            return F.lit(NAN)
        return F.when(_length() >= SHORTEST, found).otherwise(F.lit(NAN))

    counted = with_residue_counts(df, sequence)
    return counted.select(*df.columns, *[value(n).alias(n) for n in names])


def hydropathy_steps(raw: Column) -> Column:
    """Hydropathy of every position in tenths; letters outside the scale count 0."""
    scale = F.array(F.lit(0), *[F.lit(round(P.HYDROPATHY[a] * 10)) for a in P.RESIDUES])
    return F.transform(
        F.split(F.upper(raw), ""), lambda c: F.get(scale, F.instr(F.lit(P.RESIDUES), c))
    )


def has_signal_peptide(raw: Column) -> Column:
    """1 when residues 2 to 25 have a mean hydropathy above 1.0."""
    head = hydropathy_steps(F.substring(raw, 2, 24))
    total = F.aggregate(head, F.lit(0), lambda acc, x: acc + x)
    hit = (F.length(raw) >= 25) & (total > 240)
    return F.coalesce(hit, F.lit(False)).cast("double")


def max_window_sum(raw: Column, window: int) -> Column:
    """Largest hydropathy sum in tenths over ``window`` neighbours; null for shorter texts.

    Prefix sums in Arrow batches over whole sequences.
    """
    scale = np.array([round(P.HYDROPATHY[a] * 10) for a in P.RESIDUES] + [0])

    @F.pandas_udf("bigint")
    def largest(batch: pd.Series) -> pd.Series:
        def one(text: str | None) -> int | None:
            sums = np.concatenate(([0], np.cumsum(scale[residue_codes(text or "")])))
            return int((sums[window:] - sums[:-window]).max()) if len(sums) > window else None

        return batch.map(one).astype("Int64")

    return largest(raw)


def has_transmembrane(raw: Column, window: int = 19, cut: float = 1.6) -> Column:
    """1 when any 19 neighbouring residues have a mean hydropathy above 1.6."""
    hit = max_window_sum(raw, window) > round(cut * 10 * window)
    return F.coalesce(hit, F.lit(False)).cast("double")


# Order of the auxiliary targets.
AUX_EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "signal_peptide": has_signal_peptide,
    "transmembrane": has_transmembrane,
}


def aux_targets(
    raw: Column,
    extractors: Mapping[str, Callable[[Column], Column]] | None = None,
    order: Sequence[str] = ("signal_peptide", "transmembrane"),
) -> list[Column]:
    """Auxiliary target columns in fixed order; a missing extractor gives 0."""
    chosen = AUX_EXTRACTORS if extractors is None else extractors
    return [(chosen[n](raw) if n in chosen else F.lit(0.0)).alias(n) for n in order]


def python_extractor(fn: Callable[[str], float]) -> Callable[[Column], Column]:
    """Wrap a plain ``str -> float`` function for use as an extractor (Arrow batches)."""

    @F.pandas_udf("double")
    def apply(batch: pd.Series) -> pd.Series:
        return batch.map(fn, na_action="ignore").astype("float64")

    return lambda raw: apply(raw)
