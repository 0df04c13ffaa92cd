"""The import path on small cases: feeds, settings, the remote service, scans, drains, streaming helpers."""

import datetime as dt
import hashlib
import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from loomtrace import settings
from loomtrace.functions import columns as C
from loomtrace.functions import telemetry
from loomtrace.operators import canonical, drain, queue, reports, state
from loomtrace.plans import index, scan, search
from loomtrace.sources import feed, jsonl, remote, sessions
from loomtrace.streaming import delivery, settle

KEY = "source string, native_session_id string"


# -- settings


def test_environment_and_overrides():
    text = "# c\nNAME=value\n A_1='x y' \nlower=no\nQ=\"z\"\nODD='a\n"
    assert settings.read_environment(text) == {"NAME": "value", "A_1": "x y", "Q": "z", "ODD": "'a"}
    defaults = {"n": 3, "flag": False, "name": "a", "list": ["x"], "deep": {"k": 1}}
    assert settings.merge_overrides({"n": 4, "deep": {"k": 2}}, defaults) == {**defaults, "n": 4, "deep": {"k": 2}}
    for bad in ({"m": 1}, {"n": "x"}, {"n": True}, {"flag": 1}, {"name": " "}, {"list": [""]}, {"deep": {"z": 1}}, {"deep": 3}, []):
        with pytest.raises(ValueError):
            settings.merge_overrides(bad, defaults)


def test_approval(tmp_path):
    good = {"provider": "p", "model": "m", "privacy": "local", "approvedAt": "2026-01-01", "maxEstimatedInputTokens": None, "maxEstimatedCostUsd": 0, "maxFailureRate": 0.5}
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert settings.check_approval(settings.read_approval(str(tmp_path / "a.json")), "p", "m") == good
    settings.check_approval(good | {"model": "*"}, "p", "other")
    assert settings.read_approval(str(tmp_path / "none.json")) is None
    for change in ({"provider": "q"}, {"model": "n"}, {"privacy": "public"}, {"approvedAt": "soon"}, {"maxEstimatedInputTokens": 0}, {"maxEstimatedCostUsd": -1}, {"maxFailureRate": 0}, {"maxFailureRate": 1.5}, {"minFreeBytes": -1}):
        with pytest.raises(PermissionError):
            settings.check_approval(good | change, "p", "m")
    for provider in (None, "none", "unknown"):
        with pytest.raises(PermissionError):
            settings.check_approval(good, provider, "m")


def test_signature_and_retries():
    assert settings.processing_signature(["B ", "ａ"]) == settings.processing_signature(["a", "b"]) != settings.processing_signature(["a"])
    now = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    assert settings.retry_after_ms("1.5") == 1500 and settings.retry_after_ms("Thu, 01 Jan 2026 00:00:02 GMT", now) == 2000
    assert settings.retry_after_ms("later") is None and settings.retry_after_ms("Wed, 31 Dec 2025 00:00:00 GMT", now) == 0
    assert [settings.retry_delay_ms(k, 503, base_ms=100, most_ms=350) for k in range(3)] == [100, 200, 350]
    assert settings.retry_delay_ms(0, 429) == 1000 and settings.retry_delay_ms(0, 429, "2") == 2000 and settings.retry_delay_ms(5, None, left_ms=7) == 7
    assert settings.retry_delay_ms(0, 404) is None and settings.retry_delay_ms(0, 409) is None


def test_telemetry_values(spark):
    given = {"http.method": "GET", "http.route": "/v1/banks/x/recall", "gen_ai.usage.input_tokens": "NaN", "error.type": "a b", "url.scheme": "https", "text": "secret"}
    frame = spark.createDataFrame([(given,)], "m map<string,string>")
    assert frame.select(telemetry.safe_attributes(F.col("m"))).first()[0] == {"http.method": "GET", "http.route": "/v1/banks/{id}/recall", "url.scheme": "https"}
    metric = {"method": "TRACE", "operation": "recall", "success": "maybe", "token_bucket": "50k+", "status_code": "201", "endpoint": "/who", "max_tokens": "12", "status_class": "9xx"}
    frame = spark.createDataFrame([(metric,)], "m map<string,string>")
    assert frame.select(telemetry.safe_metric_attributes(F.col("m"))).first()[0] == {"operation": "recall", "token_bucket": "50k+", "status_code": "201", "endpoint": "/other", "max_tokens": "12"}
    names = spark.createDataFrame([("loomtrace.scan",), ("free text",), ("POST /v1/memories?q=1",)], "n string")
    assert [r[0] for r in names.select(telemetry.safe_name(F.col("n"))).collect()] == ["loomtrace.scan", "loomtrace.operation", "POST /v1/memories"]


# -- the remote service


DOCUMENTS = [{"id": f"d{k}", "content_hash": f"h{k}"} for k in range(457)]
CALLS = []


def service(method, route, body):
    """A stand-in for the service: a listing with a total, one without, and a refusing and a flaky route."""
    CALLS.append((method, route))
    if route.startswith("/flaky"):
        return (503, None) if len(CALLS) < 3 else (200, {"ok": True})
    if route.startswith("/refused"):
        return 400, None
    if route.startswith("/lost"):
        return 404, None
    if route == "/memories":
        return (200, {"operation_id": body["operation_id"]}) if body["operation_id"] != "bad" else (400, None)
    if route.startswith("/operations/"):
        return 200, {"status": "completed"}
    query = dict(p.split("=") for p in route.partition("?")[2].split("&"))
    offset, limit = int(query["offset"]), int(query["limit"])
    if route.startswith("/documents"):
        return 200, {"items": DOCUMENTS[offset : offset + limit], "total": len(DOCUMENTS)}
    rows = [{"operation_id": f"o{k}", "status": query.get("status", "any")} for k in range(205)]
    return 200, {"operations": rows[offset : offset + limit]}


def test_remote_listings(spark):
    name = "tests.test_flow:service"
    got = remote.listing(spark, name, "documents", "id string, content_hash string", partitions=3)
    assert sorted(map(tuple, got.collect())) == sorted((d["id"], d["content_hash"]) for d in DOCUMENTS)
    ops = remote.listing(spark, name, "operations", "operation_id string, status string", status="pending")
    assert ops.count() == 205 and {r.status for r in ops.collect()} == {"pending"}


def test_remote_calls():
    CALLS.clear()
    waits = []
    assert remote.call(service, "GET", "/flaky", sleep=waits.append) == {"ok": True} and len(waits) == 2 and waits[1] == 2 * waits[0]
    assert remote.call(service, "DELETE", "/lost") is None
    for method, route in (("GET", "/refused"), ("POST", "/lost")):
        with pytest.raises(ConnectionError):
            remote.call(service, method, route, sleep=waits.append)


def test_retain_sink_sends_once(spark, tmp_path):
    sha = hashlib.sha256(b"text").hexdigest()
    rows = [("a", "d1", sha, "text", "t", "pi", None, "token=abcdef"), ("bad", "d2", sha, "text", "t", "pi", "/w", None)]
    given = spark.createDataFrame(rows, "operation_id string, document_id string, canonical_hash string, content string, started_at string, source string, cwd string, title string")
    items = remote.retain_items(given)
    first = json.loads(items.where("operation_id = 'a'").first().item)
    assert first["metadata"] == {"source": "pi", "title": "token=[REDACTED:SECRET]", "canonical_hash": sha, "retain_policy_version": "2"} and first["update_mode"] == "replace"
    write = remote.retain_writer("tests.test_flow:service", str(tmp_path / "sent"))
    for batch in (0, 0, 1):
        write(items, batch)
    sent = {r.operation_id: (r.state, r.attempts) for r in delivery.operations(delivery.ledger(spark, str(tmp_path / "sent"))).collect()}
    assert sent == {"a": ("completed", 1), "bad": ("prepared", 3)}


# -- feeds


def test_feed_from_files(spark, tmp_path):
    root = tmp_path / "logs"
    (root / "sub").mkdir(parents=True)
    (root / "one.jsonl").write_text('{"a":1}\n')
    (root / "sub" / "torn.jsonl").write_text('{"a":1}\n{"b"')
    (root / "new.jsonl").write_text("{}\n")
    before = feed.listing(spark, str(root)).collect()
    schema = "path string, size bigint, mtime bigint"
    before = spark.createDataFrame(before, schema)
    files = feed.read(spark, str(root))
    late = spark.createDataFrame([(r.path, r.size + (r.path == "new.jsonl"), r.mtime) for r in before.collect()], schema)
    old = spark.createDataFrame([("sub/torn.jsonl", 8, 1, "x"), ("gone.jsonl", 3, 1, "y")], f"{schema}, sha256 string")
    got = {r.path: r for r in feed.capture(before, files, late, old).collect()}
    assert {p: r.verdict for p, r in got.items()} == {"one.jsonl": "captured", "sub/torn.jsonl": "deferred", "new.jsonl": "omitted", "gone.jsonl": "deferred"}
    assert (got["gone.jsonl"].sha256, got["sub/torn.jsonl"].size, got["one.jsonl"].size) == ("y", 8, 8)
    manifest = spark.createDataFrame([r for r in got.values() if r.path == "one.jsonl"])
    observed = files.where("path = 'one.jsonl'").select("path", "size", "mtime", "sha256")
    feed.verify(manifest, observed)
    with pytest.raises(ValueError, match="does not match"):
        feed.verify(manifest, files.select("path", "size", "mtime", "sha256"))
    (root / "one.jsonl").write_text("{oops\n")
    again = feed.listing(spark, str(root))
    with pytest.raises(Exception, match="malformed record"):
        feed.capture(again, feed.read(spark, str(root)), again, old).collect()


def test_feed_generations(tmp_path):
    base = tmp_path / "feed"
    base.mkdir(mode=0o700)
    for k in range(5):
        (base / "incoming" / f"generation-{k}").mkdir(parents=True)
        feed.publish(str(base), f"generation-{k}")
    assert os.path.realpath(base / "current").endswith("generation-4")
    (base / "current").unlink()
    (base / "current").symlink_to("generations/generation-0")
    assert feed.prune(str(base), 2) == 2 and sorted(os.listdir(base / "generations")) == ["generation-0", "generation-3", "generation-4"]
    with pytest.raises(ValueError):
        feed.prune(str(base), 1)
    with pytest.raises(ValueError):
        feed.publish(str(base), "../up")
    (base / "incoming" / "generation-4").mkdir()
    with pytest.raises(FileExistsError):
        feed.publish(str(base), "generation-4")
    base.chmod(0o755)
    with pytest.raises(PermissionError):
        feed.prune(str(base), 2)
    head = {"version": 1, "origin": "desktop", "sourceHome": "/h", "generation": "g"}
    assert feed.check_manifest(head, "/h", "/x/g") == head
    with pytest.raises(ValueError):
        feed.check_manifest(head, "/h", "/x/other")
    assert feed.backups_to_delete([f"db-{k}" for k in range(6)] + ["x"], ["db-.*"]) == ["db-0", "db-1"]


def test_places(spark):
    refs = spark.createDataFrame([("pi", "1", "/feed/g/a#x"), ("pi", "2", "/feed/g")], f"{KEY}, locator string")
    got = feed.with_origin(refs, "desktop", "/feed/g", "/home/h", "/feed/current")
    assert [(r.locator, r.logical_locator) for r in got.collect()] == [("/feed/current/a#x", "/home/h/a#x"), ("/feed/current", "/home/h")]
    assert [r.locator for r in feed.physical_places(got, "/feed/g", "/home/h", "/feed/current").collect()] == ["/feed/g/a#x", "/feed/g"]
    with pytest.raises(Exception, match="outside"):
        feed.with_origin(refs, "d", "/feed/gg", "/h").collect()
    both = feed.union_adapters(refs.withColumn("origin", F.lit("local")), got)
    ids = lambda *n: spark.createDataFrame([("pi", x) for x in n], KEY)
    assert feed.promoted(both, ids("1"), "local").count() == 3
    with pytest.raises(ValueError, match="absent"):
        feed.promoted(both, ids("9"), "local")
    assert reports.owner_conflicts(both).count() == 2


# -- sources


def test_codex_labels_from_long_headers(spark, tmp_path):
    log = lambda i, **more: json.dumps({"type": "session_meta", "payload": {"notes": {"id": "wrong", "x": "y" * 6000}, "id": i, **more}}) + "\n"
    (tmp_path / "a.jsonl").write_text("\n  \n" + log("c1", session_id="t1"))
    (tmp_path / "b.jsonl").write_text(log("c2", session_id="t2"))
    (tmp_path / "c.jsonl").write_text(log("c3"))
    labels = spark.createDataFrame([("t1", "by thread", "x"), ("c1", "by id", None), ("c2", " ", "title"), ("wrong", "no", None), (None, "no", None)], "id string, name string, title string")
    got = {r.native_session_id: r for r in sessions.read_sessions(spark, "codex", str(tmp_path), labels).collect()}
    assert {k: r.title for k, r in got.items()} == {"c1": "by thread", "c2": "title", "c3": None}
    bare = jsonl.read_sample_hash((tmp_path / "a.jsonl").read_bytes())
    assert got["c1"].sample_hash == jsonl.with_label(bare, "by thread") != bare
    assert got["c3"].sample_hash == jsonl.read_sample_hash((tmp_path / "c.jsonl").read_bytes())
    heads = {r.path.rsplit("/", 1)[1]: r.malformed for r in jsonl.header(jsonl.files(spark, str(tmp_path))).collect()}
    assert heads == {"a.jsonl": False, "b.jsonl": False, "c.jsonl": False}


def test_facts_file(spark, tmp_path):
    path = tmp_path / "facts.json"
    assert jsonl.reviewed_facts(spark, str(path)).count() == 0
    path.write_text(json.dumps([{"key": "k", "text": "t", "verifiedAt": "2026-01-01T00:00:00Z", "source": "s"}] * 2))
    assert [r.pos for r in jsonl.reviewed_facts(spark, str(path)).collect()] == [0, 1]
    for body, what in (('{"key": 1}', "array"), ("[" + " " * 70_000 + "]", "64 KiB"), ("oops", "array")):
        path.write_text(body)
        with pytest.raises(Exception, match=what):
            jsonl.reviewed_facts(spark, str(path)).collect()


def test_reads_that_changed_meanwhile(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"session","id":"1"}\n')
    (tmp_path / "b.jsonl").write_text("nonsense\n")
    got = sessions.read_sessions(spark, "pi", str(tmp_path))
    assert {r.status for r in sessions.dead_letters(got, "t").collect()} == {"malformed"}
    other = got.select("source", "locator", F.lit("x").alias("sample_hash"))
    assert {r.error for r in sessions.stable_sessions(got, other).collect()} == {"source changed while it was read"}
    assert sessions.stable_sessions(got, got).where("error is null").count() == 1
    # a second attempt reads what moved once; what keeps moving is an error
    for moves, errors, loads in ((0, 1, 1), (1, 1, 2), (2, 2, 2)):  # one file is malformed all the time
        looks, loaded = iter([other] * moves + [got] * 3), []
        load = lambda only: loaded.append(only) or (got if only is None else got.join(only, ["source", "locator"], "left_semi"))  # noqa: E731, B023
        found = sessions.read_stable(load, lambda: next(looks))  # noqa: B023
        assert found.count() == got.count() and found.where("error is not null").count() == errors and len(loaded) == loads


# -- scan, drain, index


def tables(spark):
    s = spark.createDataFrame([], f"{KEY}, document_id string, locator string, origin string, fingerprint string, size bigint, mtime bigint, canonical_hash string, canonical_bytes bigint, canonical_turns bigint, status string, classification string, acknowledged_hash string, acknowledged_policy string, last_seen_at string, last_error string")
    g = spark.createDataFrame([], f"{KEY}, canonical_hash string, operation_id string, state string, queued_at string, attempt_count int, error string, retain_policy_version string, repair boolean, submitted_at string, completed_at string")
    return scan.Tables(s, g, spark.createDataFrame([], f"{KEY}, fingerprint string, first_seen string"), spark.createDataFrame([], "source string, locator string, error string, observed_at string"), spark.createDataFrame([], "document_id string, indexed_hash string"))


def test_a_session_from_sight_to_import(spark, tmp_path):
    def stored(df):  # state is kept in written tables between steps
        path = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ref = lambda kind="primary", f="f1": spark.createDataFrame([("pi", "s", "/a", "local", kind, f, 1, 1)], f"{KEY}, locator string, origin string, kind string, fingerprint string, size bigint, mtime bigint")
    loaded = lambda h: spark.createDataFrame([("pi", "s", "d", h, 10, 2, "eligible", None)], f"{KEY}, document_id string, canonical_hash string, canonical_bytes bigint, canonical_turns bigint, status string, error string")
    day = lambda n: f"2026-01-0{n}T00:00:00Z"
    run = lambda r, h, t, n, **k: scan.scan(r, loaded(h), t, ["pi"], "bank", day(n), **k)
    outcome = lambda x: [r.outcome for r in x.outcomes.collect()]
    keep = lambda x: scan.Tables(*map(stored, x.tables))
    x = run(ref(), "h1", tables(spark), 1)
    assert outcome(x) == ["active"]
    x = run(ref(), "h1", keep(x), 2)
    assert outcome(x) == ["queued"]
    t = keep(x)
    assert t.candidates.count() == 0 and t.indexed.first().indexed_hash == "h1"
    assert outcome(run(ref(), "h1", t, 3)) == ["unchanged"]

    # drained: claimed, polled in vain, then completed; a repeated reply changes nothing
    g = state.claim(t.generations, t.sessions, t.generations)
    st = drain.State(g, t.sessions, spark.createDataFrame([], "operation_id string, remote_status string"))
    live = spark.createDataFrame([("pi", "s", "primary")], f"{KEY}, kind string")
    for status, after in (("pending", "submitted"), ("not_found", "processing"), ("failed", "failed")):
        todo = drain.actions(st.generations, st.sessions, st.operations, live, "bank")
        reply = todo.select("operation_id", F.lit(status).alias("status"), F.lit(None).cast("string").alias("error"))
        st = drain.State(*[stored(df) for df in drain.apply(st, todo, reply, day(4))])
        assert st.generations.first().state == after
    old = st.generations.first().operation_id
    st = st._replace(generations=stored(state.claim(st.generations, st.sessions, st.generations)))
    todo = stored(drain.actions(st.generations, st.sessions, st.operations, live, "bank"))
    assert [r.action for r in todo.collect()] == ["resubmit"]
    reply = todo.select("operation_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    for _ in range(2):
        st = drain.State(*[stored(df) for df in drain.apply(st, todo, reply, day(5))])
    row, s = st.generations.first(), st.sessions.first()
    assert row.state == "completed" and row.operation_id != old and row.attempt_count == 2 and (s.status, s.acknowledged_hash) == ("imported", "h1")
    assert drain.repair_verified(s_plan := st.sessions, st.sessions, spark.createDataFrame([("d", "h1")], "document_id string, content_hash string")).count() == 0 and s_plan.count() == 1

    # changed, then excluded: its document waits for cleanup and leaves the index
    t = t._replace(sessions=st.sessions, generations=st.generations)
    x = run(ref(f="f2"), "h2", t, 6, force=True)
    assert outcome(x) == ["queued"] and {r.canonical_hash: r.state for r in x.tables.generations.collect()} == {"h1": "completed", "h2": "queued"}
    x = run(ref("subagent"), "h2", keep(x), 7)
    assert outcome(x) == ["excluded"] and x.tables.sessions.first().status == "excluded_subagent" and x.tables.indexed.count() == 0
    assert {r.state for r in x.tables.generations.collect()} == {"cleanup_pending"}
    with pytest.raises(PermissionError):
        search.retrieval_gate(x.tables.generations)
    search.retrieval_gate(t.generations)
    gone = run(ref().limit(0), "h", t, 8)
    assert outcome(gone) == ["source_missing"] and gone.tables.sessions.first().status == "source_missing"


def test_repairs_stop(spark):
    plan = spark.createDataFrame([("pi", "a"), ("pi", "b")], KEY)
    s = spark.createDataFrame([("pi", "a", "primary", "imported", "1"), ("pi", "b", "primary", "imported", "2")], f"{KEY}, classification string, status string, acknowledged_policy string")
    g = lambda *rows: spark.createDataFrame(list(rows), f"{KEY}, state string, error string")
    none = g(("pi", "a", "completed", None))
    assert [r.native_session_id for r in drain.next_repairs(plan, s, none).collect()] == ["a"]
    assert drain.next_repairs(plan, s, g(("pi", "a", "queued", None))).count() == 0
    assert drain.next_repairs(plan, s, g(("pi", "b", "submitted", "late"))).count() == 0
    for bad in (g(("pi", "z", "queued", None)), g(("pi", "a", "failed", None))):
        with pytest.raises(RuntimeError):
            drain.next_repairs(plan, s, bad)
    with pytest.raises(RuntimeError):
        drain.next_repairs(plan, s.withColumn("classification", F.lit("subagent")), none)


def test_budget_is_reserved_before_sending(spark):
    todo = spark.createDataFrame([("pi", str(k), f"h{k}", f"d{k}", f"op{k}", f"op{k}", "poll" if k == 4 else "submit", "primary") for k in range(5)], "source string, native_session_id string, canonical_hash string, document_id string, operation_id string, previous_id string, action string, kind string")
    sizes = todo.select("source", "native_session_id", "canonical_hash", F.when(F.col("document_id") == "d1", 4000).otherwise(400).alias("canonical_bytes"))
    none = spark.createDataFrame([], "operation_id string, tokens bigint, cost double")
    first = drain.budget(todo, sizes, none, 250, 100.0, 1.0, 1.0)
    # the large one is over the cap, smaller ones after it are tried, and what is only polled costs nothing
    assert {r.operation_id: r.action for r in first.todo.collect()} == {"op0": "submit", "op1": "over_budget", "op2": "submit", "op3": "over_budget", "op4": "poll"}
    again = drain.budget(todo, sizes, first.reservations, 300, 100.0, 1.0, 1.0)
    assert {r.operation_id: r.tokens for r in again.reservations.collect()} == {"op0": 100, "op2": 100, "op3": 100}
    assert {r.operation_id for r in again.todo.where("action = 'submit'").collect()} == {"op0", "op2", "op3"}
    g = todo.select("source", "native_session_id", "canonical_hash", "operation_id", F.lit("processing").alias("state"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("submitted_at"), F.lit(None).cast("string").alias("completed_at"))
    s = spark.createDataFrame([], "source string, native_session_id string, document_id string, classification string, status string, canonical_hash string, acknowledged_hash string, acknowledged_policy string")
    replies = spark.createDataFrame([("op0", "completed", None), ("op1", "completed", None)], "operation_id string, status string, error string")
    after = {r.operation_id: (r.state, r.error) for r in drain.apply(drain.State(g.withColumn("retain_policy_version", F.lit("2")), s, spark.createDataFrame([], "operation_id string, remote_status string")), first.todo, replies, "t").generations.collect()}
    assert after["op0"] == ("completed", None) and after["op1"] == ("failed", "the approved budget is exceeded") and after["op2"][0] == "submitted"


def test_one_change_a_key(spark):
    s = spark.createDataFrame([("pi", "a", "h1", "discovered", None, None, "primary")], f"{KEY}, canonical_hash string, status string, acknowledged_hash string, acknowledged_policy string, classification string")
    g = spark.createDataFrame([("pi", "a", "h1", "completed", "1", "2026-01-01"), ("pi", "a", "h2", "completed", "2", "2026-01-02"), ("pi", "a", "h3", "failed", "2", "2026-01-03")], f"{KEY}, canonical_hash string, state string, retain_policy_version string, completed_at string")
    (row,) = state.acknowledge(s, g).collect()
    assert (row.acknowledged_hash, row.acknowledged_policy, row.status) == ("h2", "2", "imported")
    kinds = spark.createDataFrame([("pi", "a", "subagent", "j1"), ("pi", "a", "configured-exclusion", "j2")], f"{KEY}, kind string, job_id string")
    done, kept = state.finalize_excluded(g.withColumn("state", F.lit("cleanup_pending")).withColumn("error", F.lit("")), s, kinds)
    assert [r.status for r in kept.collect()] == ["excluded_configured"] and done.count() == 3
    keep = spark.createDataFrame([("pi", "a", "h1"), ("pi", "a", "h3")], f"{KEY}, keep_hash string")
    assert state.supersede(g, keep).count() == 3
    done, sessions_ = state.finish(g.withColumn("error", F.lit("x")), s, g.where("canonical_hash = 'h3'"), "2026-02-01")
    assert sessions_.first().acknowledged_hash == "h3" and done.where("state = 'completed'").count() == 3
    beat = spark.createDataFrame([], "id int, pid int, heartbeat_at string, phase string, last_error string")
    for at in ("t1", "t2"):
        beat = state.heartbeat(beat, 7, at, "scan", "e" * 5000)
    (row,) = beat.collect()
    assert row.heartbeat_at == "t2" and len(row.last_error) == 1000


def test_many_used_operation_ids(spark):
    want = spark.createDataFrame([("d", "h"), ("e", "h")], "document_id string, canonical_hash string")
    ids = [want.where("document_id = 'd'").select(C.operation_id(F.lit("b"), F.col("document_id"), F.col("canonical_hash"), *([F.lit("replay"), F.lit(str(n))] if n else []))).first()[0] for n in range(70)]
    got = {r.document_id: r.operation_id for r in queue.next_operation_ids(want, spark.createDataFrame([(i,) for i in ids[:69]], "operation_id string"), "b").collect()}
    assert got["d"] == ids[69] and len(got) == 2


def test_budget_of_several_groups(spark):
    rows = [(k, f"op{k}", "ab"[k % 2], 30 + k % 5, 0.1) for k in range(40)] + [(99, "op0", "a", 30, 0.1)]
    asked = spark.createDataFrame(rows, "pos int, operation_id string, g string, tokens bigint, cost double").repartition(5)
    spent, want = {"a": 0, "b": 0}, {}
    for pos, op, g, tokens, _ in rows:
        if (op, g) not in want:
            want[op, g] = spent[g] + tokens <= 200
            spent[g] += tokens * want[op, g]
    got = queue.reserve(asked, 200, 1e9, "g").collect()
    assert len(got) == 41 and all(r.admitted == want[r.operation_id, r.g] for r in got)
    assert queue.reserve(asked, 100, 1e9, "g", spent=(90, 0.0)).where("admitted").count() == 0


def test_index_is_updated_by_hash(spark, tmp_path):
    s = lambda *rows: spark.createDataFrame(list(rows), "document_id string, source string, native_session_id string, source_path string, canonical_hash string, classification string, status string")
    t = lambda *rows: spark.createDataFrame([(d, e, None, role, None, "2026", text) for d, e, role, text in rows], "document_id string, entry_id string, parent_entry_id string, role string, provenance string, timestamp string, content string")
    at = str(tmp_path / "index")
    first = index.update(index.read(spark, at), s(("d1", "pi", "1", "/p", "h", "primary", None), ("d2", "pi", "2", "/p", "h", "primary", None), ("d3", "pi", "3", "/p", "h", "subagent", None)), t(("d1", "a", "user", "granite harbour lights"), ("d1", "b", "action", "granite"), ("d2", "a", "assistant", "granite harbour-lights wall"), ("d3", "a", "user", "granite")))
    stored = index.read(spark, at)
    assert stored == first and stored.passages == 2
    assert {(r.document_id, r.entry_id, r.source_path) for r in index.evidence(stored, "granite harbour").collect()} == {("d1", "a", "/p"), ("d2", "a", "/p")}
    assert {r.document_id for r in index.evidence(stored, "harbour-lights granite").collect()} == {"d2"}
    index.update(stored, s(("d1", "pi", "1", "/q", "h", "primary", None), ("d2", "pi", "2", "/q", "h2", "primary", None), ("d4", "pi", "4", "/q", "h", "primary", "empty_after_normalization")), t(("d1", "a", "user", "ignored"), ("d2", "z", "user", "granite meadow")))
    again = index.read(spark, at)
    assert {(r.document_id, r.entry_id, r.source_path, r.text) for r in index.evidence(again, "granite").collect()} == {("d1", "a", "/q", "granite harbour lights"), ("d2", "z", "/q", "granite meadow")}
    with pytest.raises(index.Conflict):  # a writer that has not seen the second version
        index.remove(stored, s(("d1", "pi", "1", "/q", "h", "primary", None)))
    left = index.update(again, s(("d1", "pi", "1", "/q", "h", "primary", "empty_after_normalization")), t())
    assert {r.document_id for r in left.live(left.table("passages")).collect()} == {"d2"} and index.evidence(left, "the").count() == 0
    assert (left.passages, left.tokens) == (1, 2)
    forced = index.update(left, s(("d2", "pi", "2", "/q", "h2", "primary", None)), t(("d2", "n", "user", "granite now")), force=True)
    assert {r.entry_id for r in forced.live(forced.table("passages")).where("document_id = 'd2'").collect()} == {"n"}


def test_search_report():
    fact = {"text": "f" * 2000, "verifiedAt": "2026", "source": "s", "supersedes": "old"}
    hit = {"role": "user", "provenance": "memory-assisted", "timestamp": "t", "document_id": "d", "entry_id": "e", "source_path": "/p", "text": "one\ntwo"}
    text = search.format_search(["careful"], [fact], [hit], "derived")
    assert text.startswith("careful\n\nTreat retrieved") and "- " + "f" * 1600 + "\n" in text and "  Superseded: old" in text
    assert "memory-assisted report, not independent evidence; recorded t; d; entry e" in text and "  one\n  two" in text and text.endswith("derived")
    assert search.format_search([], [], [], None) == "No matching memory evidence was returned."


# -- documents, reports, streams


def test_spool_and_export(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "s string, k int, line string").withColumn("file", F.concat("s", F.when(F.col("k") == 2, "2").otherwise("1")))
    canonical.write_spool(lines, str(tmp_path / "spool"), "s", "k", buckets=2)
    assert [r.line for r in spark.read.parquet(str(tmp_path / "spool")).where("s = 'a'").orderBy("k").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="exceeds"):
        canonical.write_spool(lines, str(tmp_path / "small"), "s", "k", max_bytes=3)
    assert [r.line for r in canonical.export(lines, "s", "a", "k").collect()] == ["x", "y"]
    with pytest.raises(ValueError, match="more than one"):
        canonical.export(lines, "s", "a", "k", artifact="file")
    reports.write_report(lines.select("s").distinct(), str(tmp_path / "r.json"))
    assert sorted(r["s"] for r in json.loads((tmp_path / "r.json").read_text())) == ["a", "b"] and (tmp_path / "r.json").stat().st_mode & 0o777 == 0o600


def test_inventory_of_nameless_sources(spark):
    rows = spark.createDataFrame([("pi", "eligible", 1, 1, 1, 0), (None, "eligible", 1, 1, 1, 0)], "source string, status string, source_bytes int, canonical_bytes int, canonical_turns int, redactions int")
    got = {r.source: r.discovered for r in reports.inventory(rows, ["pi", "codex"]).collect()}
    assert got == {"pi": 1, "codex": 0, None: 2}
    g = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "operation_id string, queued_at int")
    assert [r.operation_id for r in reports.listed(g, "generations").collect()] == ["c", "a", "b"]


def test_outbox_has_one_effect_an_operation(spark, tmp_path):
    write = settle.outbox_writer(str(tmp_path / "out"), order="n")
    batch = lambda *rows: spark.createDataFrame(list(rows), "operation_id string, n int, v string")
    for number, rows in ((0, [("a", 2, "late"), ("a", 1, "first")]), (1, [("a", 0, "again"), ("b", 1, "b")]), (1, [("a", 0, "again"), ("b", 1, "b")]), (0, [("a", 2, "late"), ("a", 1, "first")])):
        write(batch(*rows), number)
    assert sorted((r.operation_id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "first"), ("b", "b")]


def test_heartbeat_windows(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    beats = spark.createDataFrame([(at(0),), (at(1),), (at(7),)], "ts timestamp")
    assert [r.n for r in settle.heartbeat_windows(beats).orderBy("window_start").collect()] == [2, 0, 0, 1]
    beats.write.parquet(str(tmp_path / "in"))
    stream = settle.heartbeat_windows(spark.readStream.schema(beats.schema).parquet(str(tmp_path / "in")))
    assert stream.isStreaming and stream.columns == ["window_start", "n"]


def test_loop_pauses_and_has_one_writer(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    seen, folder, loop = [], str(tmp_path), lambda b, n: seen.append(b.count())
    settle.set_paused(folder, True)
    query = settle.run_loop(stream(), folder, str(tmp_path / "cp"), loop, None, poll=0.1)
    time.sleep(5)
    assert settle.paused(folder) and query.isActive and seen == []
    settle.set_paused(folder, False)
    settle.set_paused(folder, False)
    query.awaitTermination()  # it goes on without a restart
    assert seen == [3]
    # a query that lost its checkpoint does no batch again that is committed
    settle.run_loop(stream(), folder, str(tmp_path / "other"), loop, None).awaitTermination()
    assert seen == [3]


def test_an_older_writer_is_refused(spark, tmp_path):
    first = settle.Writer(spark, str(tmp_path))
    first.commit(batch=0)
    first.check()
    second = settle.Writer(spark.newSession(), str(tmp_path))
    for refused in (first.check, first.commit):
        with pytest.raises(settle.Fenced):
            refused()
    assert second.done(0) and not second.done(1)
    second.commit(batch=1)
    assert settle.Writer(spark, str(tmp_path)).done(1)
    with pytest.raises(settle.Fenced):
        second.commit(batch=2)
    # a loop that is overtaken in the middle of a batch does not commit it
    spark.range(3).write.parquet(str(tmp_path / "in"))
    overtaken = settle.run_loop(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), str(tmp_path / "x"), str(tmp_path / "cp"), lambda b, n: settle.Writer(spark, str(tmp_path / "x")), None)
    with pytest.raises(Exception, match="another writer"):
        overtaken.awaitTermination()
    assert not settle.Writer(spark, str(tmp_path / "x")).done(0)


def test_long_secrets(spark):
    long = ['password="' + "x" * 1_000_000 + '"', "secret='" + "\\'y" * 300_000 + "'", 'token="' + "[a" * 300_000, "cookie: " + "z" * 1_000_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in long], "t string").select(C.redact(F.col("t"))).collect()]
    assert got == ['password="[REDACTED:SECRET]"', "secret='[REDACTED:SECRET]'", 'token="[REDACTED:SECRET]"', "cookie: [REDACTED:COOKIE]"]
