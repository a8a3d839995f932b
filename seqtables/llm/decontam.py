"""Operator 5: benchmark decontamination with a generalised suffix automaton over words.

The normalised items form one automaton (Blumer et al. 1985, several strings). Each document's
words stream through it; at every word the automaton gives the longest suffix read so far that
occurs in some item. A suffix of at least ``window`` words, or one that ends with a whole shorter
item, marks its words as hit. ``clean_documents`` cuts the marked spans and drops documents whose
share of marked words exceeds a limit.

The items are broadcast and each task builds the automaton. The size is proven before: items are
dealt by hash into chunks, more of them until each holds at most ``MAX_BYTES`` or one item, and
each chunk is one pass over the original texts, so a larger benchmark takes more passes and never a
larger broadcast. Spans of all passes are joined per row before anything is cut or counted, so the
number of chunks does not show in the result.

Defined results: null and empty texts have no words and are never hit; equal rows get equal
results, one output row for each input row; null item ids count under the empty string; a repeated
item id counts once; items without words match nothing; an empty benchmark marks nothing; other
columns of the input are ignored here and kept by ``clean_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqtables.llm.tables import short_lists, stored
from seqtables.llm.words import ALNUM, as_bytes

WINDOW = 10
MAX_BYTES = 8_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# A document with a larger share of hit words is dropped whole.
MAX_COVERAGE = 0.5
SPANS = "array<struct<first:int,last:int>>"
SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def item_words(text: str | None) -> list[bytes]:
    return as_bytes(text).translate(ALNUM).split()


class SuffixAutomaton:
    """Word automaton of all items with, for every state, the items of its windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.names: list[str] = []
        coded = []
        for name, words in items:
            if words:
                codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                coded.append((name, codes))
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self.extend(last, code)
        self.mark(coded)

    def split(self, state: int, code: int, target: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(code) == target:
            self.next[state][code] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, code: int) -> int:
        """State of the item read so far with one word more."""
        target = self.next[last].get(code)
        if target is not None:
            if self.length[target] == self.length[last] + 1:
                return target
            return self.split(last, code, target)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and code not in self.next[state]:
            self.next[state][code] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][code]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self.split(state, code, target)
        return new

    def mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """Per state: where its suffix of ``window`` words lives, and whole shorter items."""
        windows: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for name, codes in coded:
            state = 0
            for n, code in enumerate(codes, 1):
                state = self.next[state][code]
                if n >= self.window:
                    windows.setdefault(self.holder(state, self.window), set()).add(name)
            if len(codes) < self.window:
                whole.setdefault(self.holder(state, len(codes)), set()).add((len(codes), name))
        self.windows = windows
        # Whole items that are suffixes of a state's strings: its own and those of its links.
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            mine = sorted(whole.get(state, ())) + self.whole.get(self.link[state], [])
            if mine:
                self.whole[state] = mine

    def holder(self, state: int, n: int) -> int:
        """The state whose strings include the suffix of ``n`` words of a state's strings."""
        while state > 0 and self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    @property
    def shortest(self) -> int:
        """Least number of consecutive known words that can be a hit."""
        return min(
            [self.window, *(length for found in self.whole.values() for length, _ in found)]
        )

    def run(self, codes: list[int], at: int, spans: list, items: set[str]) -> None:
        """Reads consecutive known words that begin at word ``at``; adds what they hit."""
        state = matched = 0
        nexts, link, length = self.next, self.link, self.length
        for i, code in enumerate(codes, at):
            while state and code not in nexts[state]:
                state = link[state]
                matched = length[state]
            target = nexts[state].get(code)
            if target is None:
                continue
            state = target
            matched += 1
            long = 0
            if matched >= self.window:
                long = matched
                items |= self.windows[self.holder(state, self.window)]
            for n, name in self.whole.get(state, ()):
                if n <= matched:
                    long = max(long, n)
                    items.add(name)
            if long:
                first = i - long + 1
                while spans and first <= spans[-1][1] + 1:
                    first = min(first, spans.pop()[0])
                spans.append((first, i))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (first and last word) and the items that occur in a document."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            self.run(codes[a:b].tolist(), a, spans, items)
        return spans, items


def chunked_items(benchmark: DataFrame, item: str, text: str, most: int) -> DataFrame:
    """Distinct items with a chunk number; a chunk has at most ``most`` bytes, or one item."""
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    sized = stored(
        rows.select(
            "item", "text", F.octet_length("text").alias("size"), F.xxhash64("item", "text").alias("h")
        ),
        "benchmark-items",
    )
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    bins = -(-total // most) or 1
    while True:
        dealt = sized.withColumn("chunk", F.pmod("h", F.lit(bins)))
        chunk = dealt.groupBy("chunk").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        if chunk.filter((F.col("b") > most) & (F.col("n") > 1)).isEmpty():
            return dealt.select("item", "text", "chunk")
        bins *= 2


def held_items(items: DataFrame, chunk: int) -> list[tuple[str, list[bytes]]]:
    """The words of one chunk, whose size was bounded before."""
    rows = items.filter(F.col("chunk") == chunk).select("item", "text").collect()
    return [(r["item"], item_words(r["text"])) for r in rows]


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they overlap or adjoin."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def as_structs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"first": a, "last": b} for a, b in spans]


def one_pass(rows: DataFrame, items: DataFrame, chunk: int, window: int) -> DataFrame:
    """``(row, n_words, hits, items)`` of one chunk of items for every row of ``(row, text)``."""
    sent = rows.sparkSession.sparkContext.broadcast(held_items(items, chunk))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(sent.value, window)
        for batch in batches:
            counts, hits, names = [], [], []
            for value in batch.column(1):
                words = item_words(value.as_py())
                spans, found = automaton.scan(words)
                counts.append(len(words))
                hits.append(as_structs(spans))
                names.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(SPAN)),
                    pa.array(names, pa.list_(pa.string())),
                ],
                ["row", "n_words", "hits", "items"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(scan, f"row {kind}, n_words long, hits {SPANS}, items array<string>")


def all_passes(rows: DataFrame, items: DataFrame, chunks: list[int], window: int, hit: bool) -> DataFrame:
    """The passes joined per row, with merged spans; only rows with a hit if ``hit``."""
    found = None
    for chunk in chunks:
        more = one_pass(rows, items, chunk, window)
        more = more.filter(F.size("hits") > 0) if hit else more
        found = more if found is None else found.unionByName(more)
    joined = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("hits")
            spans = [
                as_structs(merged_spans([(h["first"], h["last"]) for h in value.as_py()]))
                for value in batch.column(place)
            ]
            kind = batch.schema.types[place]
            yield batch.set_column(place, batch.schema.field(place), pa.array(spans, kind))

    return joined.mapInArrow(merge, joined.schema)


def find_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    row_id: str,
    text: str,
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    most: int = MAX_BYTES,
) -> DataFrame:
    """``(row_id, n_words, hits, items)`` for every document row; hits are merged and in order.

    Ids keep their type. With several chunks of items each row gets a number of its own, stored with
    it, by which the passes are joined.
    """
    items = chunked_items(benchmark, item, item_text, most)
    chunks = sorted(r["chunk"] for r in items.select("chunk").distinct().collect()) or [0]
    rows = docs.select(F.col(row_id).alias("row"), F.col(text).alias("text"))
    if len(chunks) == 1:
        return one_pass(rows, items, chunks[0], window).withColumnRenamed("row", "row_id")
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "decontam-rows")
    texts = rows.select(F.col("_row").alias("row"), "text")
    found = all_passes(texts, items, chunks, window, hit=False).withColumnRenamed("row", "_row")
    ids = rows.select("_row", F.col("row").alias("row_id"))
    return ids.join(found, "_row").select("row_id", "n_words", "hits", "items")


def hit_words(spans: list[tuple[int, int]]) -> int:
    """Words covered by spans that may overlap."""
    covered, upto = 0, -1
    for first, last in sorted(spans):
        covered += max(0, last - max(first, upto + 1) + 1)
        upto = max(upto, last)
    return covered


def hit_digests(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items for each row."""

    def covered(hits):
        ordered = F.array_sort(hits)
        state = F.aggregate(
            ordered,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto")),
            lambda s, h: F.struct(
                (
                    s["n"]
                    + F.greatest(
                        F.lit(0), h["last"] - F.greatest(h["first"], s["upto"] + 1) + 1
                    ).cast("long")
                ).alias("n"),
                F.greatest(s["upto"], h["last"]).alias("upto"),
            ),
        )
        return state["n"]

    n_hit = covered(F.col("hits"))
    return found.select(
        "row_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of every span."""
    raw = as_bytes(text)
    places = [m.span() for m in WORD.finditer(raw.translate(ALNUM))]
    out, at = [], 0
    for first, last in sorted(spans):
        start, end = places[first][0], places[last][1]
        if end > at:
            out.append(raw[at : max(at, start)])
            at = end
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    most: int = MAX_BYTES,
) -> DataFrame:
    """The documents with hit spans cut out of their text.

    A document that lost more than ``max_coverage`` of its words is dropped. All columns are
    kept; a null text stays null. One chunk of items is cut while it is read; the spans of several
    chunks are gathered on the original texts, and rows are cut once by all of them.
    """
    items = chunked_items(benchmark, item, item_text, most)
    chunks = sorted(r["chunk"] for r in items.select("chunk").distinct().collect())
    if not chunks:
        return docs
    place = docs.columns.index(text)

    def cut_rows(batch: pa.RecordBatch, spans_of) -> pa.RecordBatch:
        keep, texts = [], []
        for n, value in enumerate(batch.column(place)):
            value = value.as_py()
            words = item_words(value)
            spans = spans_of(n, words)
            keep.append(hit_words(spans) <= max_coverage * len(words))
            texts.append(cut_spans(value, spans) if spans else value)
        cut_batch = batch.set_column(
            place, batch.schema.field(place), pa.array(texts, batch.schema.types[place])
        )
        return cut_batch.filter(pa.array(keep, pa.bool_()))

    if len(chunks) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(held_items(items, chunks[0]))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(sent.value, window)
            for batch in batches:
                yield cut_rows(batch, lambda n, words: automaton.scan(words)[0])

        return docs.mapInArrow(cut, docs.schema)

    # The row travels as one struct, so no column of the input can clash with a helper.
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    rows = stored(packed, "decontam-rows")
    found = all_passes(rows.select("row", F.col("doc")[text].alias("text")), items, chunks, window, hit=True)
    found = short_lists(stored(found.select("row", "hits"), "decontam-spans"), "hits")

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(1)
            plain = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=names)
            yield cut_rows(
                plain, lambda n, _: [(h["first"], h["last"]) for h in hits[n].as_py() or ()]
            )

    names = docs.columns
    return rows.join(found, "row", "left").select("doc", "hits").mapInArrow(cut_all, docs.schema)
