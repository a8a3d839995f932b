"""Host reputation, rotated dialogues and shards: rules by hand, invariants and edge cases."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqtables.llm import catalog, reputation
from seqtables.llm.reputation import registered, reputations
from seqtables.llm.perspectives import rotate_perspectives
from seqtables.llm.sharding import even_shares, shard_documents


# --- urls -----------------------------------------------------------------------------------


def judged(spark, urls):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rows = reputation.judge_urls(pages, "page_id", "url").collect()
    return {r["page_id"]: r for r in rows}


def test_rules_hosts_and_paths(spark):
    cases = {
        "http://EXAMPLE.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://a.example.org/en/12?x#y": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "https://org/": ("org", "/", "org/", "allow"),
        "https://b.org": ("b.org", "", None, None),
        "x://c.com/de/": ("c.com", "/de/", "com/de/", "block"),
        "x://c.com/FR/": ("c.com", "/FR/", None, None),
        "x://É.com/fr/://z": ("É.com", "/fr/://z", "com/fr/", "allow"),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
        "s://": ("", "", None, None),
    }
    rows = judged(spark, list(cases))
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_shrinkage_orders_hosts(spark):
    bad = [f"x://bad.com/de/{i}" for i in range(60)] + ["x://bad.com/it/1"]
    good = [f"x://good.com/fr/{i}" for i in range(60)] + ["x://good.com/it/1"]
    few = ["x://few.com/de/1", "x://few.com/it/1", "x://new.com/it/1", "x://sub.bad.com/it/"]
    rows = {r["host"]: r for r in judged(spark, bad + good + few).values() if r["rule"] is None}
    assert rows["bad.com"]["verdict"] == "block" and rows["good.com"]["verdict"] == "allow"
    rate = {h: r["block_rate"] for h, r in rows.items()}
    assert rate["good.com"] < rate["new.com"] < rate["few.com"] < rate["bad.com"]
    assert rate["sub.bad.com"] > rate["new.com"] and rows["new.com"]["host_outcomes"] == 0
    assert all(r["block_bound"] <= r["block_rate"] for r in rows.values())


def test_no_pages_and_no_outcomes(spark):
    assert judged(spark, []) == {}
    rows = judged(spark, ["x://a.net/", "x://a.net/"])
    assert {(r["verdict"], r["block_rate"]) for r in rows.values()} == {("allow", reputation.START)}


# --- dialogues ------------------------------------------------------------------------------


def rotated(spark, rows, part_turns=256):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, spans string")
    out = rotate_perspectives(frame, "conv_id", "turn", "role", "text", part_turns=part_turns)
    return sorted(out.collect(), key=lambda r: (repr(r["dialogue"]), r["perspective"], r["part"]))


def test_every_participant_is_once_the_assistant(spark):
    rows = [
        (1, 0, "system", "be kind", "", ""), (1, 1, "ann", "hé", "", ""), (1, 2, "bob", "ho", "", ""),
        (1, 3, "cy", None, "", ""), (1, 4, "ann", "bye", "", ""), (1, 5, None, "who", "", ""),
        (2, 0, "system", "nobody", "", ""), (None, 0, "ann", "lost", "", ""), (None, 0, "ann", "lost", "", ""),
    ]
    out = rotated(spark, rows)
    assert [(r["dialogue"], r["perspective"]) for r in out] == [(1, "ann"), (1, "bob"), (1, "cy"), (None, "ann")]
    ann = out[0]
    assert ann["text"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhé<|im_end|>\n"
        "<|im_start|>user name=bob\nho<|im_end|>\n<|im_start|>user name=cy\n<|im_end|>\n"
        "<|im_start|>assistant\nbye<|im_end|>\n<|im_start|>user\nwho<|im_end|>\n"
    )
    assert [ann["text"][s["start"] : s["end"]] for s in ann["spans"]] == ["hé<|im_end|>", "bye<|im_end|>"]
    assert out[3]["n_turns"] == 2


def test_parts_join_to_the_whole(spark):
    rows = [(7, i, f"s{i % 3}", "t" * i, "", "") for i in range(11)]
    whole = rotated(spark, rows)
    parts = rotated(spark, rows, 4)
    for r in whole:
        mine = [p for p in parts if p["perspective"] == r["perspective"]]
        assert [p["part"] for p in mine] == [0, 1, 2] and max(p["n_turns"] for p in mine) == 4
        assert "".join(p["text"] for p in mine) == r["text"]
        assert sum(len(p["spans"]) for p in mine) == len(r["spans"])
    assert rotated(spark, []) == []


# --- shards ---------------------------------------------------------------------------------


def check(rows, n, shards):
    assert len(rows) == n
    counts = Counter(r["shard"] for r in rows)
    full = [counts.get(s, 0) for s in range(shards)]
    assert sum(full) == n and max(full) - min(full) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_query(spark, sf, documents):
    rows = catalog.queries()["op4_shards"](spark, sf).collect()
    check(rows, len(documents), 24)
    groups = {}
    for r in rows:
        raw = documents[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        groups.setdefault(raw, set()).add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 2


def test_groups_stay_together_and_hot_groups_fill_shards(spark, docs):
    rows = [(i, f"text {i // 3}" if i < 240 else f"alone {i}") for i in range(600)]
    rows += [(600 + i, "hot") for i in range(300)]
    found = shard_documents(docs(rows), "doc_id", "text", shards=6).collect()
    check(found, 900, 6)
    shard = {r["row_id"]: r["shard"] for r in found}
    split = sum(len({shard[i] for i in range(3 * g, 3 * g + 3)}) > 1 for g in range(80))
    assert split <= 8
    hot = Counter(shard[600 + i] for i in range(300)).most_common()
    assert sum(n for _, n in hot[:3]) >= 270


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "x"), (3, "x"), (3, "x"), (4, "é" * 100_000)]])
def test_edges(spark, docs, rows):
    found = shard_documents(docs(rows), "doc_id", "text", shards=4).collect()
    check(found, len(rows), 4)
    assert Counter(r["size"] for r in found) == Counter(len((t or "").encode()) + 8 for _, t in rows)


def test_even_shares():
    assert even_shares({0: 1, 2: 9}, 4) == {0: 3, 1: 2, 2: 3, 3: 2}
    assert sum(even_shares({}, 5).values()) == 0


def test_sharding_uses_no_python_rows(spark, docs):
    plan = shard_documents(docs([(1, "a"), (2, "a")]), "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    turns = spark.createDataFrame([(1, 0, "a", "x")], "c long, t long, r string, x string")
    plan = rotate_perspectives(turns, "c", "t", "r", "x").select(F.col("text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_suffixes_of_several_labels(spark):
    hosts = ["a.shop.co.uk", "b.shop.co.uk", "other.co.uk", "co.uk", "x.uk", "y.example.com", "com", ""]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    table = spark.createDataFrame([("CO.uk",), ("uk",), (None,), ("co.uk",)], "suffix string")
    found = {r["host"]: (r["domain"], r["suffix"]) for r in registered(frame, table).collect()}
    assert found == {
        "a.shop.co.uk": ("shop.co.uk", "co.uk"),
        "b.shop.co.uk": ("shop.co.uk", "co.uk"),
        "other.co.uk": ("other.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "x.uk": ("x.uk", "uk"),
        "y.example.com": ("example.com", "com"),
        "com": ("com", "com"),
        "": ("", ""),
    }


def test_sites_under_one_suffix_do_not_share_outcomes(spark):
    bad = [(f"h{i}.bad.co.uk", 1) for i in range(6) for _ in range(20)]
    good = [(f"s{k}.co.uk", 0) for k in range(30) for _ in range(20)]
    rows = spark.createDataFrame([*bad, *good, ("new.bad.co.uk", None), ("new.co.uk", None)], "host string, bad int")
    table = spark.createDataFrame([("co.uk",)], "suffix string")
    rate = {r["host"]: r["mean"] for r in reputations(rows, table).collect()}
    assert rate["new.bad.co.uk"] > 0.7 and rate["new.co.uk"] < 0.3
