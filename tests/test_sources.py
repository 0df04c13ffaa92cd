"""Session sources on inline logs of the four layouts."""

import json
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import plain as P
from loomtrace.sources import classify, jsonl, sessions

T = "2026-01-01T00:00:0{}.000Z"


def text(role, body):
    return {"role": role, "content": [{"type": "text", "text": body}]}


PI = [
    {"type": "session", "id": "p1", "timestamp": T.format(0), "cwd": "/w"},
    {"type": "message", "id": "a", "timestamp": T.format(1), "message": text("user", "<memory>x</memory>question")},
    {"type": "message", "id": "b", "parentId": "a", "timestamp": T.format(2), "message": {"role": "assistant", "content": [{"type": "text", "text": "looking"}, {"type": "toolCall", "name": "memory_search", "arguments": {"query": "q"}}]}},
    {"type": "message", "id": "c", "parentId": "b", "timestamp": T.format(3), "message": {"role": "toolResult", "content": "hidden"}},
    {"type": "message", "id": "d", "parentId": "c", "timestamp": T.format(4), "message": text("assistant", "from memory")},
    {"type": "message", "id": "e", "parentId": "a", "timestamp": T.format(5), "message": text("assistant", "other branch")},
    {"type": "session_info", "id": "f", "name": "My name"},
]
CODEX = [
    {"timestamp": T.format(0), "type": "session_meta", "payload": {"id": "c1", "source": "cli"}},
    *[{"timestamp": T.format(1), "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}}] * 2,
    {"timestamp": T.format(2), "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": "ls"})}},
    {"timestamp": T.format(3), "type": "response_item", "payload": {"type": "reasoning", "text": "no"}},
]
CLAUDE = [
    {"sessionId": "k1", "uuid": "1", "timestamp": T.format(0), "type": "user", "message": {"role": "user", "content": "hello"}},
    {"uuid": "2", "parentUuid": "1", "timestamp": T.format(1), "type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "memory_search", "input": {}}]}},
    {"uuid": "3", "parentUuid": "2", "timestamp": T.format(9), "isMeta": True, "message": {"role": "user", "content": "skipped"}},
    {"uuid": "4", "parentUuid": "3", "timestamp": T.format(2), "message": {"role": "assistant", "content": "child of a skipped record"}},
    {"uuid": "5", "parentUuid": "2", "timestamp": T.format(3), "message": {"role": "assistant", "content": "recalled"}},
]


def dump(records, end="\n"):
    return "\n".join(map(json.dumps, records)) + end


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for source, records in (("pi", PI), ("codex", CODEX), ("claude", CLAUDE)):
        (root / source).mkdir()
        (root / source / "one.jsonl").write_text(dump(records))
    (root / "pi" / "bad.jsonl").write_text(dump(PI[:1]) + "not-json\n")
    (root / "pi" / "torn.jsonl").write_text(dump(PI[:2]) + '{"type":"message"')
    return root


def turns(row):
    return [(t.role, t.content, t.provenance) for t in row.turns[1:]]


def test_pi(spark, logs):
    found = {r.locator.rsplit("/", 1)[1]: r for r in sessions.read_sessions(spark, "pi", str(logs / "pi")).collect()}
    one = found["one.jsonl"]
    assert turns(one) == [("user", "question", None), ("assistant", "looking", "original"), ("action", "Search prior memory", None), ("assistant", "from memory", "memory-assisted"), ("assistant", "other branch", "original")]
    assert (one.document_id, one.title, one.classification.kind, one.updated_at) == ("agent-session:pi:p1", "My name", "primary", T.format(5))
    assert one.turns[0].content == "REF-ID: agent-session:pi:p1"
    assert found["bad.jsonl"].status == "malformed" and len(found["torn.jsonl"].turns) == 2
    assert sessions.turns_of(sessions.read_sessions(spark, "pi", str(logs / "pi"))).count() == 8


def test_codex(spark, logs):
    labels = spark.createDataFrame([("c1", None, "Titled")], "id string, name string, title string")
    (one,) = sessions.read_sessions(spark, "codex", str(logs / "codex"), labels).collect()
    assert turns(one) == [("user", "hi", None), ("action", "Run shell command", None)]  # arguments in a string are not read
    assert one.title == "Titled"


def test_claude(spark, logs):
    (one,) = sessions.read_sessions(spark, "claude", str(logs / "claude")).collect()
    assert turns(one)[-2:] == [("assistant", "child of a skipped record", "original"), ("assistant", "recalled", "memory-assisted")]
    assert one.updated_at == T.format(9)


def test_opencode(spark, tmp_path):
    path = str(tmp_path / "s.db")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE session(id TEXT PRIMARY KEY, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT); CREATE TABLE message(id TEXT, session_id TEXT, time_created INT, data TEXT); CREATE TABLE part(id TEXT, message_id TEXT, time_created INT, data TEXT);")
    for k in range(5):
        db.execute("INSERT INTO session VALUES (?, ?, '/d', ?, 1700000000000, 1700000009000)", (f"s{k}", "p" if k == 1 else None, "x (@y subagent)" if k == 1 else "t"))
        for n, (role, data) in enumerate([("user", {"type": "text", "text": f"ask {k}"}), ("assistant", {"type": "tool", "tool": "memory_search", "state": {"input": {}}}), ("assistant", {"type": "text", "text": "answer"})]):
            db.execute("INSERT INTO message VALUES (?, ?, ?, ?)", (f"m{k}{n}", f"s{k}", n, json.dumps({"role": role})))
            db.execute("INSERT INTO part VALUES (?, ?, ?, ?)", (f"q{k}{n}", f"m{k}{n}", n, json.dumps(data)))
    db.execute("INSERT INTO message VALUES ('bad', 's4', 9, '{')")
    db.commit()
    db.close()
    found = {r.native_session_id: r for r in sessions.read_opencode(spark, path, 2).collect()}
    assert len(found) == 5 and found["s4"].status == "malformed"
    assert turns(found["s0"]) == [("user", "ask 0", None), ("action", "Search prior memory", None), ("assistant", "answer", "memory-assisted")]
    assert (found["s1"].classification.kind, found["s0"].classification.kind) == ("subagent", "primary")


def database(path, n):
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE session(id TEXT PRIMARY KEY, parent_id TEXT, title TEXT, time_created INT, time_updated INT); CREATE TABLE message(id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT); CREATE TABLE part(id TEXT, message_id TEXT, time_created INT, data TEXT);")
    for k in range(n):
        db.execute("INSERT INTO session VALUES (?, NULL, 't', 1, 2)", (f"s{k:02d}",))
    for k in range(3 * n):  # also of sessions that do not exist, and not in order
        i = (7 * k) % (3 * n)
        db.execute("INSERT INTO message VALUES (?, ?, ?, ?, ?)", (f"m{i}", f"s{i % (n + 2):02d}", i % 4, i, json.dumps({"role": "user"})))
        for j in range(i % 3):
            db.execute("INSERT INTO part VALUES (?, ?, ?, ?)", (f"p{i}-{j}", f"m{i}", 5 - j, json.dumps({"type": "text", "text": f"é {i} {j}"})))
    db.commit()
    return db


def test_opencode_scans_merge_as_lookups_do(tmp_path):
    """Three ordered scans give what a lookup for each session and message gives."""
    path = str(tmp_path / "s.db")
    db = database(path, 13)
    asked = []
    reader = sessions._Reader(path, 3)
    plain = reader._open
    reader._open = lambda: (c := plain(), c.set_trace_callback(asked.append))[0]
    got = {}
    for part in reader.partitions():
        asked.clear()
        for batch in reader.read(part):
            got |= dict(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        assert sum(q.startswith("SELECT") for q in asked) == 3
    assert sorted(got) == [f"s{k:02d}" for k in range(13)]
    for id_, text in got.items():
        said = db.execute("SELECT id, time_created, time_updated, data FROM message WHERE session_id = ? ORDER BY time_created, id", (id_,)).fetchall()
        inside = {m[0]: db.execute("SELECT id, time_created, NULL, data FROM part WHERE message_id = ? ORDER BY time_created, id", (m[0],)).fetchall() for m in said}
        every = db.execute("SELECT id, time_created, NULL, data FROM part WHERE message_id IN (SELECT id FROM message WHERE session_id = ?) ORDER BY time_created, id", (id_,)).fetchall()
        row = json.loads(text)
        assert row["messages"] == [[[m[0], m[1], m[3]], [p[3] for p in inside[m[0]]]] for m in said]
        assert row["fingerprint"] == sessions.fingerprint(dict(zip(sessions.SESSION_COLUMNS, row["row"], strict=True)), said, every)


def test_opencode_filters_reach_the_database(spark, tmp_path):
    path = str(tmp_path / "s.db")
    database(path, 13).close()
    ids = lambda where: sorted(r.native_session_id for r in sessions.read_opencode(spark, path, 3, where).collect())
    id_ = F.col("id")
    tests = {"s05": id_ == "s05", "s11 s12": id_ > "s10", "s00 s01": id_ <= "s01", "s03 s07": id_.isin("s03", "s07", "zz"), "s10 s11 s12": id_.startswith("s1"), "s02": (id_ >= "s02") & (id_ < "s03"), "s09": id_.endswith("9"), "": id_ == "nobody"}
    for pushed in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        try:
            assert {want: ids(where) for want, where in tests.items()} == {want: want.split() for want in tests}
            plan = spark.read.format("opencode_sessions").option("path", path).option("pushdown", pushed).load().where(id_ == "s05")._jdf.queryExecution().executedPlan().toString()
            assert (re.search(r"\bFilter\b", plan) is None) == (pushed == "true")
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tail_safe_lines(spark, tmp_path):
    """Only terminated lines count, wherever a writer has been stopped."""
    whole = '{"n":0}\r\n \n{"n":1,"s":"é中"}\n\n{"n":2}\r\n'.encode()
    ends = [k + 1 for k, b in enumerate(whole) if b == 10 and whole[:k].rsplit(b"\n", 1)[-1].strip()]
    for cut in range(len(whole) + 1):
        assert [x.value["n"] for x in jsonl.read_lines(whole[:cut])] == list(range(sum(e <= cut for e in ends)))
    assert [(x.number, x.record) for x in jsonl.read_lines(whole)] == [(1, 1), (3, 2), (5, 3)]
    for name, cut in (("all", len(whole)), ("torn", len(whole) - 2), ("split", whole.index(b"\xa9")), ("none", 3)):
        (tmp_path / f"{name}.jsonl").write_bytes(whole[:cut])
    found = jsonl.records(jsonl.files(spark, str(tmp_path)))
    counts = {r.path.rsplit("/", 1)[1].split(".")[0]: r["count"] for r in found.groupBy("path").count().collect()}
    assert counts == {"all": 3, "torn": 2, "split": 1}
    assert {(r.line_no, r.record_no) for r in found.where(F.col("path").endswith("all.jsonl")).collect()} == {(1, 1), (3, 2), (5, 3)}
    for bad in (b"{\n", b'{"n":0}\n[1,\n{"n":2}\n', b"\xff\n"):
        with pytest.raises(ValueError):
            jsonl.read_lines(bad)
    big = tmp_path / "big.bin"
    big.write_bytes(b"x" * 70_000 + b"y" * 70_000)
    got = spark.read.format("binaryFile").load(str(big)).select(jsonl.sample_hash(F.col("content"))).first()[0]
    assert got == jsonl.read_sample_hash(big.read_bytes())


def test_too_large():
    row = sessions.load_session("pi", "/r/x.jsonl", "/r", dump(PI).encode(), max_bytes=100)
    assert row["status"] == "too_large"


@pytest.mark.parametrize(
    ("path", "name", "parent", "kind"),
    [("a/b/run-1/session.jsonl", "subagent-x", None, "subagent"), ("x.jsonl", "x#0123abcd", "p", "subagent"), ("tasks/x.jsonl", None, "p", "subagent"), ("x.jsonl", None, "p", "ambiguous"), ("x.jsonl", "subagent-x", None, "ambiguous"), ("x.jsonl", None, None, "primary")],
)
def test_pi_rules(spark, path, name, parent, kind):
    frame = spark.createDataFrame([(path, name, parent)], "path string, name string, parent string")
    assert frame.select(classify.pi(F.col("path"), F.col("name"), F.col("parent"))["kind"]).first()[0] == kind
    records = [{"type": "session", "id": "i", "timestamp": T.format(0), "parentSession": parent}, {"type": "session_info", "name": name}]
    row = sessions.load_session("pi", f"/r/{path}", "/r", dump(records).encode())
    assert row["classification"]["kind"] == kind


@pytest.mark.parametrize(
    ("payload", "kind"),
    [({"source": "subagent"}, "subagent"), ({"source": {"subagent": "x"}}, "subagent"), ({"source": {"subagent": None}}, "ambiguous"), ({"source": {"x": 1}}, "ambiguous"), ({"source": "web"}, "ambiguous"), ({"thread_source": "odd"}, "ambiguous"), ({"source": "exec"}, "primary"), ({"agent_role": "r"}, "ambiguous")],
)
def test_codex_rules(payload, kind):
    row = sessions.load_session("codex", "/r/x.jsonl", "/r", dump([{"type": "session_meta", "payload": {"id": "i", **payload}}]).encode())
    assert row["classification"]["kind"] == kind


def test_canonical_line_order():
    assert P.canonical_line({"content": "é\x1b", "role": "user", "timestamp": "t", "provenance": None}) == '{"role":"user","content":"é\\u001b","timestamp":"t"}'
