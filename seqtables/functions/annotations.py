"""Annotation text -> label arrays, all as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqtables import params as P


def no_labels() -> Column:
    return F.array().cast("array<string>")


def strip(col: Column) -> Column:
    """Trim every kind of ASCII whitespace, not only blanks."""
    return F.btrim(col, F.lit(" \t\n\x0b\f\r"))


def is_topology(col: Column, terms: Sequence[str] = P.TOPOLOGY_TERMS) -> Column:
    return F.lower(col).rlike("|".join(re.escape(t) for t in terms))


def parse_annotations(col: Column, terms: Sequence[str] = P.TOPOLOGY_TERMS) -> Column:
    """Raw labels of an annotation text, in order, duplicates kept; no text -> no labels."""
    body = F.substring_index(
        F.replace(col, F.lit(P.ANNOTATION_PREFIX), F.lit("")), P.NOTE_MARK, 1
    )
    pieces = F.flatten(F.transform(F.split(body, r"\."), lambda s: F.split(s, ";")))
    named = F.transform(pieces, lambda p: strip(F.regexp_replace(p, P.EVIDENCE_PATTERN, "")))
    kept = F.filter(named, lambda p: (F.length(p) > 0) & ~is_topology(p, terms))
    return F.coalesce(kept, no_labels())


def map_to_groups(labels: Column, groups: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Sorted distinct groups; a raw label takes the first group with a matching keyword."""
    groups = P.LOCATION_GROUPS if groups is None else groups

    def group_of(raw: Column) -> Column:
        low = F.lower(raw)
        case = None
        for name, keywords in groups.items():
            hit = reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in keywords])
            case = F.when(hit, name) if case is None else case.when(hit, name)
        return F.lit(None).cast("string") if case is None else case

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(labels, group_of))))


def labels_to_string(labels: Column) -> Column:
    return F.array_join(labels, "|")


def string_to_labels(text: Column) -> Column:
    """Inverse of :func:`labels_to_string`; null or empty text -> no labels."""
    parts = F.filter(F.split(text, r"[|]"), lambda x: F.length(x) > 0)
    return F.coalesce(parts, no_labels())


def single_label(labels: Column) -> Column:
    """Keep element 0; label arrays are sorted, so this is the alphabetically first class."""
    return F.slice(labels, 1, 1)


def multi_hot(labels: Column, vocabulary: Sequence[str]) -> Column:
    """0/1 array in vocabulary order; labels outside the vocabulary are ignored."""
    return F.array(
        *[F.coalesce(F.array_contains(labels, v), F.lit(False)).cast("int") for v in vocabulary]
    )


def external_tokens(text: Column) -> Column:
    trimmed = F.transform(F.split(text, r"[|]"), strip)
    return F.coalesce(F.filter(trimmed, lambda x: F.length(x) > 0), no_labels())


def map_external_labels(text: Column, label_map: Mapping[str, str] | None = None) -> Column:
    """Exact case-insensitive lookup of ``|``-separated names, first-seen order, no repeats."""
    label_map = P.EXTERNAL_LABELS if label_map is None else label_map
    table = F.create_map(
        *[F.lit(x) for k, v in label_map.items() for x in (k.strip().lower(), v)]
    )
    mapped = F.transform(external_tokens(text), lambda t: F.try_element_at(table, F.lower(t)))
    return F.array_distinct(F.array_compact(mapped))


def record_id_aliases(record_id: Column) -> Column:
    """The id, plus the second ``|`` field when there are at least three and it is not empty."""
    fields = F.split(record_id, r"[|]")
    second = F.when((F.size(fields) >= 3) & (F.length(fields[1]) > 0), fields[1])
    return F.array_compact(F.array(record_id, second))


def organism_name(organism_id: Column, names: Mapping[int, str] | None = None) -> Column:
    """Known taxonomy ids by name, other numbers as ``organism_<id>``, text unchanged."""
    names = P.ORGANISM_NAMES if names is None else names
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(int(k)), F.lit(v))])
    text = organism_id.cast("string")
    number = text.try_cast("bigint")
    return F.coalesce(
        F.try_element_at(table.cast("map<bigint,string>"), number),
        F.concat(F.lit("organism_"), number.cast("string")),
        text,
    )
