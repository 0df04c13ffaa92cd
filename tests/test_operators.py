"""State, queue, report and streaming operators on small tables; the catalog against DuckDB."""

import datetime as dt

import duckdb
import pandas as pd
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomtrace import catalog, catalog_flow, catalog_stream  # noqa: F401
from loomtrace.operators import canonical, queue, reports, state
from loomtrace.plans import search
from loomtrace.streaming import settle

SF = "/root/testdata/sf0.001"
GEN = "source string, native_session_id string, canonical_hash string, operation_id string, state string, queued_at string, attempt_count int, error string"


def gen(spark, *rows):
    return spark.createDataFrame([("pi", s, h, f"op-{s}{h}", st, q, a, None) for s, h, st, q, a in rows], GEN)


def states(df):
    return {r.native_session_id + r.canonical_hash: r.state for r in df.collect()}


def sessions(spark, **status):
    return spark.createDataFrame([("pi", s, "d" + s, "h", c, st, None, None, "t", None) for s, (c, st) in status.items()], "source string, native_session_id string, document_id string, canonical_hash string, classification string, status string, acknowledged_hash string, acknowledged_policy string, last_seen_at string, last_error string")


def test_work_queue_order(spark):
    names = ["queued", "queued", "submitted", "processing", "failed", "completed", "superseded", "excluded", "cleanup_pending"]
    g = gen(spark, *[(str(k), "h", s, f"{9 - k}", 3 if k == 4 else 0) for k, s in enumerate(names)])
    ids = lambda n, m: [r.native_session_id for r in queue.candidates(g, n, m).collect()]
    assert ids(3, 3) == ["3", "2", "1"] and ids(100, 3) == ["3", "2", "1", "0"] and ids(100, 4) == ["3", "2", "1", "0", "4"]
    assert (queue.pending(g, 3).first()[0], queue.pending(g, 4).first()[0]) == (4, 5)


def test_claim_is_serial(spark):
    g = gen(spark, ("a", "1", "queued", "1", 0), ("a", "2", "queued", "2", 0), ("b", "1", "failed", "1", 1), ("c", "1", "queued", "1", 0))
    s = sessions(spark, a=("primary", "discovered"), b=("primary", "discovered"), c=("subagent", "discovered"))
    once = state.claim(g, s, g)
    assert states(once) == {"a1": "processing", "a2": "queued", "b1": "processing", "c1": "queued"}
    assert states(state.claim(once, s, g)) == states(once)


def test_transitions(spark):
    g = gen(spark, ("a", "1", "failed", "1", 3), ("a", "2", "queued", "2", 0), ("b", "1", "completed", "1", 1), ("b", "2", "cleanup_pending", "1", 1))
    s = sessions(spark, a=("primary", "discovered"), b=("primary", "ambiguous_preserved"))
    assert states(state.cancel_queued(g))["a2"] == "superseded"
    assert states(state.reset_failed(g, s))["a1"] == "queued"
    assert states(state.cleanup_pending(g, s.where("native_session_id = 'b'"))) == {"a1": "failed", "a2": "queued", "b1": "cleanup_pending", "b2": "cleanup_pending"}
    keep = spark.createDataFrame([("pi", "a", "2")], "source string, native_session_id string, keep_hash string")
    assert states(state.supersede(g, keep))["a1"] == "superseded"
    gone = {r.native_session_id: r.status for r in state.mark_missing(s, s, "now").collect()}
    assert gone == {"a": "source_missing", "b": "ambiguous_preserved"}
    seen = state.mark_seen(state.mark_missing(s, s, "now"), s, "later")
    assert {r.status for r in seen.collect()} == {"discovered", "ambiguous_preserved"}
    kinds = spark.createDataFrame([("pi", "b", "subagent")], "source string, native_session_id string, kind string")
    done, kept = state.finalize_excluded(g, s, kinds)
    assert states(done)["b2"] == "excluded" and {r.status for r in kept.collect()} == {"discovered", "excluded_subagent"}
    completed = spark.createDataFrame([("pi", "a", "h", "2")], "source string, native_session_id string, canonical_hash string, retain_policy_version string")
    row = {r.native_session_id: r for r in state.acknowledge(s, completed).collect()}["a"]
    assert (row.status, row.acknowledged_hash) == ("imported", "h")
    ids = g.where("state = 'cleanup_pending'").select("source", "native_session_id", "canonical_hash", F.lit("new").alias("new_operation_id"))
    assert states(state.requeue_after_cleanup(g, ids))["b2"] == "queued"


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a", "x"), (None, "n", "y")], "k int, v string, w string")
    c = spark.createDataFrame([(1, None, None), (2, "b", "z"), (None, "m", None)], "k int, v string, w string")
    got = {r.k: (r.v, r.w) for r in state.upsert(t, c, ["k"], keep=["v"]).collect()}
    assert got == {1: ("a", None), 2: ("b", "z"), None: ("m", None)}
    assert state.delete(t, c.where("k = 1"), ["k"]).count() == 1


def test_budget(spark):
    asked = spark.createDataFrame([(1, "op-1", 60, 0.1), (2, "op-1", 60, 0.1), (3, "op-3", 60, 0.1), (4, "op-4", 10, 9.0), (5, "op-5", 40, 0.1)], "pos int, operation_id string, tokens bigint, cost double")
    got = {r.pos: r.admitted for r in queue.reserve(asked, 100, 1.0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert queue.release(asked, asked.where("operation_id <> 'op-5'")).first().tokens == 40


def test_budget_in_blocks_equals_the_fold(spark):
    """Sizes that overflow early, late and often, in one group and in several, against reading them one by one."""
    rng = random.Random(7)
    falling = [n for k in range(60) for n in (1, 100 - k)]
    shapes = {"a": [rng.randint(1, 90) for _ in range(150)], "b": falling, "c": [10] * 150, "d": [500] + [1] * 149, "e": [None, 0] * 30, None: [99, 2, 1, 1] * 20}
    rows = [(k, f"{g}-{k}", g, n, "0.1" if g == "c" else "0.001") for g, sizes in shapes.items() for k, n in enumerate(sizes)]
    rows += [(900 + k, f"a-{k}", "a", 1, "0") for k in range(20)]  # repeats
    asked = spark.createDataFrame(rows, "pos int, operation_id string, g string, tokens bigint, cost string").withColumn("cost", F.col("cost").cast("double")).repartition(3)

    def fold(rows, group):
        left, out = {}, {}
        for _, op, g, n, cost in sorted(rows, key=lambda r: r[0]):
            k = g if group else 0
            room, money = left.setdefault(k, [100, Decimal("2.5")])
            if (k, op) not in out:
                out[k, op] = (n or 0) <= room and Decimal(cost) <= money
                if out[k, op]:
                    left[k] = [room - (n or 0), money - Decimal(cost)]
        return out

    for group, block, most in (("g", 13, 60), ("g", 10_000, 1), (None, 40, 20)):
        rows_ = rows if group else [r for r in rows if r[2] == "b"]
        found = queue.admission(asked if group else asked.where("g = 'b'"), 100, 2.5, group, block_rows=block)
        want = fold(rows_, group)
        got = found.requests.collect()
        assert len(got) == len(rows_) and all(r.admitted == want[(r.g if group else 0), r.operation_id] for r in got)
        assert 1 <= found.rounds <= most


def test_enqueue_and_ids(spark):
    s = sessions(spark, a=("primary", "discovered"), b=("subagent", "discovered"), c=("primary", "empty_after_normalization"))
    got = queue.enqueue(s, gen(spark).limit(0), "bank", "2", "now").collect()
    assert [r.native_session_id for r in got] == ["a"] and not got[0].repair
    used = spark.createDataFrame([(got[0].operation_id,)], "operation_id string")
    again = queue.next_operation_ids(s.where("native_session_id = 'a'"), used, "bank").first().operation_id
    assert again != got[0].operation_id


def pilot(sizes, count, largest):
    """Plain re-statement of the sample."""
    order = [s for s in ("pi", "codex", "claude", "opencode") if sizes.get(s)]
    groups = {s: sorted(sizes[s]) for s in order}
    picked = []

    def add(s, i):
        if len(picked) < count and (s, groups[s][i]) not in picked:
            picked.append((s, groups[s][i]))

    for s in order:
        add(s, 0)
    if largest and count >= 2 * len(order):
        for s in order:
            add(s, -1)
    for d in range(10):
        for s in order:
            add(s, (len(groups[s]) - 1) * d // (9 if largest else 10))
    rest = {s: [x for x in groups[s] if (s, x) not in picked] for s in order}
    k = 0
    while len(picked) < count and any(k < len(r) for r in rest.values()):
        for s in order:
            if k < len(rest[s]) and len(picked) < count:
                picked.append((s, rest[s][k]))
        k += 1
    return picked


@pytest.mark.parametrize(("count", "largest"), [(20, False), (8, True), (60, True), (5, True), (200, False)])
def test_pilot(spark, count, largest):
    sizes = {"pi": list(range(1, 31)), "codex": list(range(1, 31)), "claude": [5], "opencode": list(range(10, 40))}
    frame = spark.createDataFrame([(s, f"{x:04d}", x) for s, xs in sizes.items() for x in xs], "source string, native_session_id string, canonical_bytes int")
    got = [(r.source, r.canonical_bytes) for r in reports.pilot(frame, count, largest).orderBy("pick").collect()]
    assert got == pilot(sizes, count, largest)


def test_settle_batch_and_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [("pi", "a", "x", at(0)), ("pi", "a", "x", at(30)), ("pi", "a", "y", at(40)), ("pi", "a", "y", at(59)), ("pi", "b", "x", at(0)), ("pi", "a", "x", at(59))]
    frame = spark.createDataFrame(rows, "source string, native_session_id string, fingerprint string, observed_at timestamp")
    want = [(r.native_session_id, r.fingerprint, r.observed_at, r.settled) for r in state.settle(frame.withColumn("_tie", F.col("fingerprint") == "x"), ["source", "native_session_id"], F.col("observed_at"), "fingerprint", 1200).collect()]
    assert {(f, a.minute) for _, f, a, s in want if s} == {("x", 30)}
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = settle.settled(stream, 1200).writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.native_session_id, r.fingerprint, r.observed_at, r.settled) for r in spark.table("settled").collect()]
    assert {x for x in got if x[3]} == {x for x in want if x[3]} and len(got) == len(rows)
    out = frame.select(F.col("fingerprint").alias("operation_id"))
    for _ in range(2):
        settle.outbox_writer(str(tmp_path / "out"))(out, 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_readiness_and_issues(spark):
    names = "pending failed missing excluded_present unexpected mismatches scan_errors deferred unprocessed stale_sources active_operations pending_consolidation failed_consolidation".split()
    row = spark.range(1).select(*[F.lit(0).alias(n) for n in names], F.lit(True).alias("bank_ready"), F.lit(True).alias("auto_consolidation"), F.lit(False).alias("running"), F.lit(False).alias("paused"), F.lit(None).cast("string").alias("last_error"))
    r = reports.readiness(row).first()
    assert r.activation_ready and not r.continuous_ready
    assert not reports.readiness(row.withColumn("pending_consolidation", F.lit(1))).first().idempotency_ready
    flags = "paused not_running stale_sources feed_stale cycle_error scan_errors uncertain unhealthy disconnected".split()
    status = spark.range(1).select(*[F.lit(f in ("paused", "scan_errors")).alias(f) for f in flags])
    assert reports.issues(status).first().issues == ["importer paused", "scan errors"]


def test_plan_hash_and_limits(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    h = lambda df: reports.plan_hash(df, "k").first()[0]
    assert h(a) == h(a.orderBy(F.desc("k"))) != h(a.withColumn("v", F.lit("z")))
    lines = a.select(F.lit("s").alias("s"), "k", F.col("v").alias("line"))
    assert canonical.sessions(lines, "s", "k", max_bytes=3).first().status == "too_large"
    with pytest.raises(ValueError, match="no session"):
        canonical.export(lines, "s", "other", "k")


def test_provenance_of_deep_chains(spark):
    n, events = 3000, {1: True, 1500: False, 2900: True}
    turns = [("a", k, f"e{k}", f"e{k - 1}" if k else None, events.get(k)) for k in range(n)]
    turns += [("a", n + k, f"leaf{k}", f"e{k}", None) for k in (5, 2000, 2950)]
    turns += [("b", 0, "e0", "e1", None), ("b", 1, "e1", "e0", True), ("b", 2, "e2", "e1", None), ("b", 3, "e3", "lost", None), (None, 0, "e0", None, True)]
    frame = spark.createDataFrame(turns[::-1], "session string, seq int, entry string, parent string, event boolean").repartition(4)
    want = {("a", f"e{k}"): 1 <= k < 1500 or k >= 2900 for k in range(n)} | {("a", "leaf5"): True, ("a", "leaf2000"): False, ("a", "leaf2950"): True}
    want |= {("b", "e0"): False, ("b", "e1"): True, ("b", "e2"): True, ("b", "e3"): False, (None, "e0"): True}
    found = canonical.provenance_tree(frame).collect()
    assert len(found) == len(turns) and {(r.session, r.entry): r.pending_out for r in found} == want


def test_search_ranks_caps_and_corrections(spark):
    rows = [("m1", f"e{k}", f"2026-0{k}", f"the kiln in hall seven runs at {k}00 degrees") for k in range(1, 5)]
    rows += [("m1", "fix", "2026-09", "hall seven: the kiln was removed, correction of the plan"), ("m2", "x", "2026-10", "kiln"), ("m3", "y", "2026-08", "a hall of mirrors")]
    found = spark.createDataFrame([(*r, 1) for r in rows], "document_id string, entry_id string, timestamp string, text string, passage_no int")
    hits = search.evidence(found, "is the kiln in hall seven still on today").orderBy("bucket").collect()
    assert (hits[0].entry_id, hits[0].bucket) == ("fix", 0) and [h.document_id for h in hits].count("m1") == search.PER_DOCUMENT
    assert {h.document_id for h in hits} == {"m1"}  # one term of three is no match
    before = search.evidence(found, "was the kiln in hall seven on before").collect()
    assert len(before) == search.PER_DOCUMENT and {h.bucket for h in before} == {1}
    assert search.evidence(found, "to be or").count() == 0
    facts = spark.createDataFrame([(k, key, text, "2026-01-01T00:00:00Z", "log", None) for k, (key, text) in enumerate([("kiln hall", "sold, password=abc"), ("oven", "kiln"), ("kiln", "hall")])], "pos int, key string, text string, verifiedAt string, source string, supersedes string")
    got = search.reviewed_facts(facts, "kiln hall").collect()
    assert [r.pos for r in got] == [0, 2] and got[0].text == "sold, password=[REDACTED:SECRET]"
    with pytest.raises(Exception, match="Invalid reviewed fact"):
        search.reviewed_facts(facts.withColumn("source", F.lit(None).cast("string")), "kiln hall").collect()


def test_passage_headings(spark):
    doc = "# One\n\nfirst\n\nLabel:\n\n" + "x" * 1700 + "\n\nafter\n\n## Two\n\nsecond"
    got = [r.text for r in search.passages(spark.createDataFrame([(1, doc)], "k int, content string"), ["k"]).orderBy("passage_no").collect()]
    assert got == ["# One\n\nfirst", "# One\n\nLabel:\n\n" + "x" * 1700, "# One\n\nLabel:\n\n" + "x" * 100, "# One\n\nafter", "## Two\n\nsecond"]


def values(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("~" if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_catalog(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "events documents pages labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)
