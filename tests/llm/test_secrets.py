"""Secret scans against plain regular expressions, the ledger and redaction."""

import hashlib
import re

from pyspark.sql import functions as F

from seqtables.llm import catalog, secrets
from seqtables.llm.secrets import LEDGER, RULES, redact_texts, rules_version, scan_history, secret_digests
from seqtables.session import scratch_path

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEY = "AKIA" + "A1" * 8
HEX = "0123456789abcdef" * 2


def base(text):
    spans = [
        (m.start(), 0, m.end())
        for m in re.finditer(ASSIGN, text or "", re.I | re.A)
        if len(m.group(2)) >= 6
    ]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    return [f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans)]


def check(rows, texts):
    for r in rows:
        want = base(texts[r["doc_id"]])
        kinds = [w.split(":")[0] for w in want]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            kinds.count(k) for k in ("assign", "access", "hex")
        ]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) or not want


def test_query_matches_brute_force(spark, sf, documents):
    rows = catalog.queries()["op10_secret_scan"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    check(rows, documents)


def test_edge_texts(spark, docs):
    texts = {
        1: None,
        2: "",
        3: "é " * 50 + f"Password = 'abc.def' {HEX}{KEY}",
        4: "token=abc token: secret=abcdef1",
        5: "AKIA" + "B" * 15 + " " + "f" * 23 + " API_KEY:" + "x" * 6,
        6: "ſecret=abcdefgh toKen=abcdefgh",
        7: "a" * 300_000 + f" passwd:{'q' * 7} ",
        8: f"secret={HEX}",
        9: "-----BEGIN RSA PRIVATE KEY-----\nMIIabc/+=\n",
    }
    rows = secret_digests(scan_history(docs(list(texts.items())), "doc_id", "text")).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert {r["doc_id"] for r in rows if "pem:" in r["spans"]} == {9}


def test_repeats_nulls_and_empty_table(spark, docs):
    found = scan_history(docs([(1, KEY), (1, KEY), (None, KEY), (2, "no")]), "doc_id", "text")
    rows = sorted((repr(r["path"]), len(r["findings"])) for r in found.collect())
    assert rows == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]
    assert scan_history(docs([]), "doc_id", "text").count() == 0


def test_ledger_scans_only_unseen_pairs(spark, docs):
    ledger = scratch_path(spark, "test-ledger")
    scan_history(docs([(1, KEY), (2, "x")]), "doc_id", "text", ledger).count()
    again = scan_history(docs([(3, KEY), (4, "y"), (5, "y")]), "doc_id", "text", ledger)
    assert {r["path"]: len(r["findings"]) for r in again.collect()} == {3: 1, 4: 0, 5: 0}
    kept = spark.read.parquet(ledger)
    assert kept.count() == kept.select("blob").distinct().count() == 3
    newer = RULES[:1]
    third = scan_history(docs([(1, KEY)]), "doc_id", "text", ledger, newer)
    assert [len(r["findings"]) for r in third.collect()] == [0]
    assert kept.sparkSession.read.parquet(ledger).filter(F.col("rules") == rules_version(newer)).count() == 1


def test_redaction_keeps_rows_and_columns(spark, docs):
    rows = docs([(1, f"é token=abcdefgh {HEX} z"), (2, None), (3, "plain"), (4, f"secret={HEX}{KEY}!")])
    out = redact_texts(rows, scan_history(rows, "doc_id", "text"), "text")
    assert out.columns == rows.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        1: "é [secret] [secret] z",
        2: None,
        3: "plain",
        4: "[secret]!",
    }


def test_ledger_written_twice_gives_each_row_once(spark, docs):
    ledger = scratch_path(spark, "test-ledger-twice")
    rows = docs([(1, KEY), (2, "x")])
    scan_history(rows, "doc_id", "text", ledger).count()
    again = spark.read.parquet(ledger).collect()
    spark.createDataFrame(again, LEDGER).write.mode("append").parquet(ledger)
    found = scan_history(rows, "doc_id", "text", ledger).collect()
    assert sorted((r["path"], len(r["findings"])) for r in found) == [(1, 1), (2, 0)]


def test_redaction_by_a_shuffle_gives_equal_rows(spark, docs, monkeypatch):
    rows = docs([(i, f"a token=abcdefgh{i % 3} b" if i % 2 else "plain") for i in range(40)])
    found = scan_history(rows, "doc_id", "text")
    small = sorted(map(repr, redact_texts(rows, found, "text").collect()))
    monkeypatch.setattr(secrets, "short_lists", lambda hits, lists: hits)
    assert sorted(map(repr, redact_texts(rows, found, "text").collect())) == small
