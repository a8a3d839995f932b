"""Similar texts on tables whose buckets grow: what is compared, moved and read."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtables import catalog
from seqtables import params as P
from seqtables.catalog import splitting
from seqtables.operators import similarity as Sim
from seqtables.plans import prepare as plans


def letters(rng, n):
    return "".join(rng.choice(P.RESIDUES) for _ in range(n))


def noted_tables(monkeypatch):
    """Rows of the tables that a search stores, by name."""
    rows = {}
    store = Sim.stored_table

    def stored(df, name, *options):
        out = store(df, name, *options)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Sim, "stored_table", stored)
    return rows


def all_pairs(texts, k, sketch, identity, coverage):
    """Clusters by a comparison of all pairs that share a sketched k-mer."""
    sets = {i: Sim.kmer_set(t, k) for i, t in texts.items()}
    marks = {i: set(np.sort(Sim.kmer_hash(s))[:sketch].tolist()) for i, s in sets.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        short, long = sorted((len(texts[a]), len(texts[b])))
        if marks[a] & marks[b] and short >= coverage * long and Sim.jaccard(sets[a], sets[b]) >= identity:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in texts}


def test_unlike_texts_of_a_bucket_give_no_pairs(spark, monkeypatch):
    """Texts that share a tenth of their k-mers were pairs by chance: 128 bytes told them apart badly."""
    rng = random.Random(4)
    common = letters(rng, 180)
    texts = [common + letters(rng, 780) for _ in range(150)]
    rows = noted_tables(monkeypatch)
    df = spark.createDataFrame(list(enumerate(texts)), "accession int, sequence string")
    found = dict(Sim.cluster_similar(df).collect())
    assert found == {i: i for i in range(150)}
    assert rows["tiles"] > 150 and rows["distinct-pairs"] == 0


def test_blocks_of_a_large_bucket_meet_by_length(spark):
    """Rows were copied to all pairs of a bucket's blocks: 400 rows of 20 blocks 8,000 times."""
    rows = [(i, 100 + i * i // 40, [7]) for i in range(400)]
    reps = spark.createDataFrame(rows, "rid long, len int, buckets array<long>")
    tiles = Sim.dealt_tiles(reps, 20, 0.8).collect()
    assert len(tiles) < 2_500
    held = {}
    for t in tiles:
        held.setdefault((t["ti"], t["tj"]), []).append((t["block"], t["rid"]))
    assert max(map(len, held.values())) <= 50
    seen = set()
    for (ti, tj), members in held.items():
        for (x, a), (y, b) in combinations(members, 2):
            if ti == tj or x != y:
                pair = (min(a, b), max(a, b))
                assert pair not in seen
                seen.add(pair)
    for a, b in combinations(range(400), 2):
        assert rows[a][1] < 0.8 * rows[b][1] or (a, b) in seen


def test_blocks_hold_rows_of_one_length(spark):
    """A group of one length is dealt by hash, so no block holds all of it."""
    reps = spark.createDataFrame([(i, 300, [7, 8]) for i in range(300)], "rid long, len int, buckets array<long>")
    tiles = Sim.dealt_tiles(reps, 50, 0.8)
    most = tiles.groupBy("bucket", "ti", "tj", "block").count().agg(F.max("count")).first()[0]
    assert most <= 80
    pairs = tiles.alias("x").join(tiles.alias("y"), ["bucket", "ti", "tj"])
    pairs = pairs.filter("x.rid < y.rid AND (ti = tj OR x.block <> y.block)").select("bucket", "x.rid", "y.rid")
    assert pairs.count() == pairs.distinct().count() == 2 * 300 * 299 // 2


@pytest.mark.parametrize("block", [1_000, 30])
def test_links_among_many_pairs_near_the_bound(spark, monkeypatch, block):
    """A passage brings all pairs near the bound; the few links among them are found with the texts of open tiles."""
    rng = random.Random(6)
    passage, texts = letters(rng, 125), {}
    for i in range(0, 90, 2):
        own = letters(rng, 35)
        texts[i], texts[i + 1] = (passage + own + letters(rng, 140) for _ in range(2))
    rows = noted_tables(monkeypatch)
    df = spark.createDataFrame(list(texts.items()), "accession int, sequence string")
    found = dict(Sim.cluster_similar(df, block_rows=block).collect())
    want = all_pairs(texts, 6, 20, P.IDENTITY, P.COVERAGE)
    assert found == want and len(set(want.values())) < 80
    assert rows["open-tiles"] > 0 and rows["live-rows"] > 0 and (rows["open-links"] > 0 or block < 1_000)


def test_signatures_admit_links_and_refuse_unlike_sets():
    rng = np.random.default_rng(8)
    may = Sim.MayLink(0.3, 0.8)
    for n in (8, 40, 150, 700, 4_000):
        sets, links = [], []
        for share in np.linspace(0.02, 0.9, 150):
            both = rng.integers(0, 2**61, round(n * share))
            for _ in range(2):
                sets.append(np.sort(np.concatenate((both, rng.integers(0, 2**61, n - len(both))))))
            links.append(Sim.jaccard(sets[-1], sets[-2]))
        words = np.stack([np.frombuffer(Sim.signature(s).tobytes(), np.uint64) for s in sets])
        size = np.array([len(s) for s in sets])
        rows = Sim.Rows(np.full(len(sets), 500), size, words)
        a = np.arange(0, len(sets), 2)
        near, sure = may.pairs(rows, a, a + 1)
        links = np.array(links)
        assert near[links >= 0.3].all() and not sure[links < 0.3].any()
        assert not near[links < 0.1].any() or n < 40
        assert sure[links > 0.5].all() or n < 150
        # All rows at once tell the same pairs.
        told = {(int(i), int(j)): bool(s) for x in may.blocks(rows) for i, j, s in zip(*x)}
        assert {(i, i + 1) for i in a[near].tolist()} <= told.keys()
        assert all(told[i, i + 1] == s for i, s in zip(a[near].tolist(), sure[near].tolist()))


def test_homology_split_reads_its_pages_once(spark, monkeypatch):
    """The pages were cleaned five times: for the labels, the sketches, the keys of the clusters twice and the rows."""
    rng = random.Random(2)
    seen = spark.sparkContext.accumulator(0)

    def note(text):
        seen.add(1)
        return text

    pages = [(f"P{i}", letters(rng, 80), "SUBCELLULAR LOCATION: LARGE.", "9", i) for i in range(60)]
    raw = spark.createDataFrame(pages, "Entry string, text string, `Subcellular location [CC]` string, `Organism (ID)` string, ord int")
    noted = F.udf(note, "string").asNondeterministic()
    raw = raw.withColumn("Sequence", noted("text")).drop("text")
    monkeypatch.setattr(splitting, "raw_pages", lambda spark, sf: raw)
    out = catalog.queries()["homology_split"](spark, "").collect()
    assert len(out) == 60 and {r["split"] for r in out} == {"train", "val", "test"}
    assert seen.value == 60


def test_unusable_first_rows_still_hide_later_ones(spark):
    """The first row of an accession counts even if its sequence is unusable, stored or not."""
    rows = [("a", "M" * 5, 1), ("a", "M" * 50, 2), ("b", "C" * 50, 3), ("b", None, 4), ("c", None, 5), ("c", "W" * 60, 6)]
    raw = spark.createDataFrame(rows, "Entry string, Sequence string, ord int")
    raw = raw.withColumn("Subcellular location [CC]", F.lit("SUBCELLULAR LOCATION: LARGE."))
    for store in (False, True):
        found = plans.prepare(raw, ["ord"], {"Large": ["large"]}, min_samples=1, store=store)
        assert [tuple(r)[:2] for r in found.collect()] == [("b", "C" * 50)]
        assert found.columns == ["accession", "sequence", "locations", "locations_str"]
