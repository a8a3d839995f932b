"""Packing: ids by the tokenizer itself, gapless sequences, and the search against brute force."""

import itertools
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqtables.llm import catalog, packing
from seqtables.llm.packing import (
    ChunkEncoder,
    best_fit,
    lower_bound,
    pack_documents,
    fillings,
    plan_packing,
    plan_rows,
)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(catalog.tokenizer_path())


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


def check(rows, texts, tokenizer, capacity=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        want, at = ids(tokenizer, texts[doc]), 0
        for i, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at)
            assert i == 0 or r["length"] == capacity
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(length for p in by_sequence.values() for _, length in p)


def test_query(spark, sf, documents, tokenizer):
    rows = catalog.queries()["op7_pack"](spark, sf).collect()
    used, tokens = check(rows, documents, tokenizer)
    counts = np.bincount([r["length"] for r in rows], minlength=1025)
    assert lower_bound(counts) <= used <= sum(n for _, n in best_fit(counts))


def test_edge_texts(spark, docs, tokenizer):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "same text", 5: "same text", 6: "<|endoftext|> x"}
    packed = pack_documents(docs(list(texts.items())), "doc_id", "text", catalog.tokenizer_path())
    check(packed.withColumnRenamed("row_id", "doc_id").collect(), texts, tokenizer)
    assert pack_documents(docs([]), "doc_id", "text", catalog.tokenizer_path()).count() == 0
    twice = pack_documents(docs([(7, "a"), (7, "a"), (None, "b")]), "doc_id", "text", catalog.tokenizer_path())
    assert len({(r["sequence_id"], r["offset"]) for r in twice.collect()}) == 3


def test_chunked_ids_are_the_tokenizers(tokenizer):
    import random

    draw = random.Random(5)
    with open(catalog.tokenizer_path(), "rb") as file:
        encoder = ChunkEncoder(file.read())
    bits = [" ", "  ", "\n", "\t", " \n", "a", "b'", "'s", "Ü", "1", "!?", " ", "　", "漢", " x", " y,", " zz.\n"]
    for _ in range(3_000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 10)))
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        assert next(encoder.batch([text])) == want.tobytes()


class Recorder:
    """A tokenizer that keeps what it was asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_chunks_are_encoded_in_short_texts(tokenizer):
    with open(catalog.tokenizer_path(), "rb") as file:
        encoder = ChunkEncoder(file.read())
    encoder.tokenizer = recorder = Recorder(encoder.tokenizer)
    text = " ".join(f"chunk{i},{i}" for i in range(5_000))
    texts = [text, text + " ", "x" + text, "a\n b", "b c\n d", "c\n", "", " ", "d <|endoftext|> c"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(encoder.batch(texts)) == want == list(encoder.batch(texts))
    assert max(t.count(" ") for t in recorder.asked if not t.startswith(text)) <= 64


def test_tasks_of_a_worker_share_what_was_learnt(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 3)
    with open(catalog.tokenizer_path(), "rb") as file:
        sent = SimpleNamespace(value=file.read())
    encoder, learnt = packing.shared_encoder(sent), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda chunks: (learnt.extend(chunks), learn(chunks)))
    texts = ["a first task", "a first task again", "b other words here now", "c first other task"]
    for text in texts:
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        assert list(packing.shared_encoder(sent).batch([text])) == [want.tobytes()]
    assert packing.shared_encoder(sent) is encoder
    assert learnt.count("first") == 1 and learnt.count("task") == 1
    assert len(encoder.memory) + len(encoder.older) <= 3 + 4 + 4


def optimum(sizes, capacity):
    """Fewest bins, by trying all assignments up to symmetry."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_search_finds_the_optimum_of_small_cases():
    draw = np.random.default_rng(4)
    for _ in range(60):
        sizes = sorted(draw.integers(3, 60, 9).tolist(), reverse=True)
        counts = np.bincount(sizes, minlength=101)
        patterns, bound = plan_packing(counts)
        used = sum(n for _, n in patterns)
        best = optimum(sizes, 100)
        assert bound <= best == used
        held = itertools.chain.from_iterable(p * n for p, n in patterns)
        assert sorted(held, reverse=True) == sizes
        assert all(sum(p) <= 100 for p, _ in patterns)


def test_plan_rows_cover_every_rank_once():
    rows = plan_rows([((60, 40), 2), ((60, 20, 20), 3)])
    spots = {(size, r) for size, lo, hi, *_ in rows for r in range(lo, hi)}
    assert spots == {(60, i) for i in range(5)} | {(40, i) for i in range(2)} | {(20, i) for i in range(6)}


@pytest.mark.parametrize("low,high,over", [(50, 160, 0), (20, 61, 0), (30, 401, 0), (120, 260, 8)])
def test_search_fills_sequences_of_many_short_pieces(low, high, over):
    sizes = np.random.default_rng(0).integers(low, high, 6000)
    counts = np.bincount(sizes, minlength=1025)
    patterns, bound = plan_packing(counts)
    used = np.zeros(1025, dtype=np.int64)
    for pattern, times in patterns:
        assert sum(pattern) <= 1024 and times > 0
        np.add.at(used, list(pattern), times)
    assert (used == counts).all()
    assert sum(n for _, n in patterns) <= bound + over


def test_fillings_against_all_subsets():
    draw = np.random.default_rng(9)
    for _ in range(80):
        sizes = draw.integers(2, 30, 7).tolist()
        gap, waste = int(draw.integers(10, 60)), int(draw.integers(0, 12))
        found = fillings(np.bincount(sizes, minlength=61), gap, waste)
        sums = {sum(s) for k in range(8) for s in itertools.combinations(sizes, k) if sum(s) <= gap}
        # The tightest filling is always there, and nothing beyond the waste allowed is.
        assert all(gap - sum(f) <= waste for f in found)
        assert (gap - max(sums) <= waste) == bool(found)
        if found:
            assert sum(found[0]) == max(sums)
        for f in found:
            rest = list(sizes)
            for x in f:
                rest.remove(x)
            assert not rest or min(rest) > gap - sum(f) or len(f) <= 1
