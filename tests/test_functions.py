"""Scalar functions: plain and Column forms against each other and against known results."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import columns as C
from loomtrace.functions import plain as P
from loomtrace.plans import search

KEY = "A" * 16
SECRETS = [
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
    "Authorization: Bearer abc.def",
    "x-api-key: 12345",
    "Cookie: session=1; b=2",
    "postgres://user:hunter2@host/db and https://u:pw@host/x",
    "https://h/?token=abc&x=1&api_key=def",
    'API_KEY="quoted \\" value" PASSWORD=\'single\' token: bare',
    f"éAKIA{KEY} AKIA{KEY}",
    "aws_secret_access_key = abc/def",
    "ghp_" + "a" * 30,
    "sk-" + "a" * 30,
    "AIza" + "b" * 35,
    "bearer abc",
    'secret = "never closed',
]


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values)))).select(column).first()[0]


@pytest.mark.parametrize("text", SECRETS)
def test_redaction_agrees_and_is_idempotent(spark, text):
    plain, n, rules = P.redact(text)
    assert n > 0 and rules and "[REDACTED:" in plain
    assert P.redact(plain)[0] == plain
    assert one(spark, C.redact(F.col("c0")), text) == plain


def test_redaction_leaves_prose(spark):
    text = "token count: 120; password policy: strong; normal=value"
    assert P.redact(text) == (text, 0, [])
    assert one(spark, C.redact(F.col("c0")), text) == text


def test_normalize_and_strip(spark):
    for text in (" a\r\nb ", "﻿x ", "<memory>no</memory>yes\n\n\n\nend", "[HERMES RECALL] gone\n\nkept", "<system-reminder>x</system-reminder>", "a <!-- HINDSIGHT\n--> b"):
        assert one(spark, C.normalize_text(F.col("c0")), text) == P.normalize_text(text)
        assert one(spark, C.strip_injected(F.col("c0")), text) == P.strip_injected(text)
    text = "# AGENTS.md instructions for /x\n\n<INSTRUCTIONS>a</INSTRUCTIONS>\n<environment_context>b</environment_context>\nreal <environment_context>c</environment_context>"
    assert P.strip_harness(text) == "real <environment_context>c</environment_context>" == one(spark, C.strip_harness(F.col("c0")), text)
    assert P.normalize_text(" a\r\nb ") == "a\nb"


def test_actions():
    assert P.action_text("Read", {"path": "src/db.ts"}) == "Read src/db.ts"
    assert P.action_text("write", {"file_path": "a"}) == "Write a" and P.action_text("Write", {"file_path": "a"}) == "Edit a"
    assert P.action_text("bash", {}) == "Run shell command" and P.action_text("memory_search", {}) == "Search prior memory"
    assert P.action_text("custom", {"query": "q  r"}) == "custom q r" and P.action_text(None, None) == "Use unknown tool"
    assert len(P.shorten("é" * 900).encode()) <= 802


def test_identifiers(spark):
    assert one(spark, C.operation_id(F.col("c0"), F.col("c1")), "a", "é") == P.operation_id("a", "é")
    assert uuid.UUID(P.operation_id("a")).version == 5
    assert one(spark, C.fallback_id(F.col("c0"), F.col("c1"), F.lit("t")), "pi", "k") == P.fallback_id("pi", "k", "t")
    assert P.normalize_label("EXCLUDED－SESSION ") == "excluded-session"


def test_times(spark):
    assert P.iso(1_700_000_000, "f") == "2023-11-14T22:13:20.000Z" == P.iso(1_700_000_000_000, "f")
    assert P.iso("nonsense", "f") == "f" and P.iso(None, "f") == "f"
    assert one(spark, C.iso(F.col("c0"), F.lit("f")), "1700000000") == "2023-11-14T22:13:20.000Z"
    assert one(spark, C.iso(F.col("c0"), F.lit("f")), "x") == "f"
    assert P.file_timestamp("pi", "2026-01-01T10-02-01-005Z_x.jsonl") == "2026-01-01T10:02:01.005Z"


def test_truncation_and_counts(spark):
    for text in ("é" * 10, "abc", "🎉" * 5):
        got = one(spark, C.truncate_bytes(F.col("c0"), 7), text)
        assert len(got.encode()) <= 7 and text.startswith(got) and len(text.encode()) - len(got.encode()) >= 0
    assert one(spark, C.matched_terms(F.col("c0"), ["plan", "roll-back", "x"]), "The plan: roll-back") == 2
    row = spark.sql("select cast('nan' as double) a, -1.0d b, 2.7d c").select(*[C.whole_count(F.col(x)) for x in "abc"]).first()
    assert tuple(row) == (0, 0, 2)


def test_query_terms():
    assert P.query_terms("What is the ROLLBACK plan for Logical-Backups plan") == ["rollback", "plan", "logical-backups"]
    assert P.explicit_terms("Tell March about Kafka and 1234x") == ["kafka", "1234x"]
    assert P.wants_recent("current plan") and not P.wants_recent("the plan before, currently")


def test_bm25_matches_sqlite(spark):
    import sqlite3

    texts = ["the quick fox", "quick quick dog", "café-bar fox_trot", "nothing here", "a fox and a dog and a fox"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE p USING fts5(text, tokenize='unicode61')")
    db.executemany("INSERT INTO p(rowid, text) VALUES (?, ?)", list(enumerate(texts)))
    terms = ["fox", "quick", "cafe-bar"]
    want = dict(db.execute("SELECT rowid, rank FROM p WHERE p MATCH ?", (" OR ".join(f'"{t}"' for t in terms),)).fetchall())
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r["rank"] for r in search.scored(frame, terms, ["id"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_recall_format():
    results = [{"id": "a", "text": "low", "scores": {"final": 0.0012}}, {"id": "b", "text": "kept", "scores": {"final": 0.02}, "metadata": {"source": "pi", "native_session_id": "s"}}, {"id": "b", "text": "again"}]
    text = search.format_recall({"results": results})
    assert "Found 1 derived memory match." in text and "relative score 0.0200" in text and "pi session s" in text
    assert "Found 2" in search.format_recall({"results": results}, floor=0.001)
    assert search.format_recall({}).startswith("No matching")
    assert len(search.bound("é" * 60_000).encode()) <= 51_200 and search.bound("x\n" * 3000).count("\n") <= 2002


def test_sha_twins(spark):
    assert one(spark, F.sha2("c0", 256), "é") == hashlib.sha256("é".encode()).hexdigest()


def test_terms_match_after_normalization(spark):
    texts = ["ＦＵＬＬ－width ﬁne", "full-width fine", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.matched_terms(F.col("t"), ["fine", "full-width"])).collect()] == [2, 2, 0]
