"""Delivery with crashes, repeats, refusals, repairs and restarts: one completed row an operation."""

import hashlib
import json
import os
import shutil
from pathlib import Path

import pytest

from loomtrace.streaming import delivery

ITEM = "operation_id string, document_id string, canonical_hash string, item string, repair boolean, acknowledged_hash string"
#: Where the service of these tests keeps what it has been told, for all processes.
PLACE = Path(os.environ.setdefault("DELIVERY_TEST_PLACE", f"/tmp/delivery-test-{os.getpid()}"))


def told():
    return [json.loads(line) for line in (PLACE / "calls").read_text().splitlines()] if (PLACE / "calls").exists() else []


def service(method, route, body):
    """A service that knows operations again, refuses and breaks as the file ``rules`` says."""
    rules = json.loads((PLACE / "rules").read_text())
    with open(PLACE / "calls", "a") as f:
        f.write(json.dumps([method, route, (body or {}).get("operation_id")]) + "\n")
    if method == "POST":
        op = body["operation_id"]
        if op in rules.get("refuse", []):
            return 400, None
        (PLACE / f"op-{op}").write_text(body["items"][0]["content"])
        if op in rules.get("crash", []):
            raise SystemError("the machine is gone")  # after the service has taken it
        return 200, {"operation_id": op}
    kind, _, name = route.strip("/").partition("/")
    if kind == "operations":
        if not (PLACE / f"op-{name}").exists():
            return 404, None
        return 200, {"status": "pending" if name in rules.get("slow", []) else "failed" if name in rules.get("fail", []) else "completed"}
    if method == "DELETE":
        return 200, {}
    return (200, {"content_hash": rules["remote"][name]}) if name in rules.get("remote", {}) else (404, None)


@pytest.fixture
def rules():
    shutil.rmtree(PLACE, ignore_errors=True)
    PLACE.mkdir()
    put = lambda **given: (PLACE / "rules").write_text(json.dumps(given))
    put()
    yield put
    shutil.rmtree(PLACE, ignore_errors=True)


def items(spark, *names, content="text", repair=False, acknowledged=None):
    rows = [(n, f"d-{n}", hashlib.sha256(content.encode()).hexdigest(), json.dumps({"content": content}), repair, acknowledged) for n in names]
    return spark.createDataFrame(rows, ITEM)


def states(spark, path):
    return {r.operation_id: (r.state, r.attempts) for r in delivery.operations(delivery.ledger(spark, path)).collect()}


def pending(path):
    return sorted(p.stem for p in Path(path).glob("pending/*/*.json"))


NAME = "tests.test_delivery:service"


def test_repeats_are_sent_once(spark, tmp_path, rules):
    path = str(tmp_path)
    for _ in range(3):
        delivery.deliver(items(spark, "a", "b", "a"), path, NAME)
    assert states(spark, path) == {"a": ("completed", 1), "b": ("completed", 1)} and pending(path) == []
    assert sorted(c[2] for c in told() if c[0] == "POST") == ["a", "b"]


def test_failed_then_accepted(spark, tmp_path, rules):
    path = str(tmp_path)
    rules(refuse=["a"])
    delivery.deliver(items(spark, "a", "b"), path, NAME)
    assert states(spark, path)["a"] == ("prepared", 1) and pending(path) == ["a"]
    rules()
    for _ in range(2):
        delivery.deliver(items(spark, "a", "b"), path, NAME)
    assert states(spark, path) == {"a": ("completed", 2), "b": ("completed", 1)} and pending(path) == []


def test_crash_between_send_and_commit(spark, tmp_path, rules):
    path = str(tmp_path)
    rules(crash=["c"])
    with pytest.raises(Exception, match="machine is gone"):
        delivery.deliver(items(spark, "a", "b", "c"), path, NAME, inflight=1)
    # nothing of the batch counts, though the service has all of it
    assert states(spark, path) == {} and (PLACE / "op-c").exists()
    rules()
    delivery.deliver(items(spark, "a", "b", "c"), path, NAME)
    assert {s for s, _ in states(spark, path).values()} == {"completed"} and len(states(spark, path)) == 3 and pending(path) == []
    assert delivery.ledger(spark, path).where("state = 'completed'").count() == 3


def test_payload_belongs_to_its_operation(spark, tmp_path, rules):
    path = str(tmp_path)
    rules(refuse=["a"])
    delivery.deliver(items(spark, "a"), path, NAME)
    place = next(Path(path).glob("pending/*/a.json"))
    body = json.loads(place.read_text())
    place.write_text(json.dumps(body | {"item": json.dumps({"content": "forged"})}))
    rules()
    delivery.deliver(items(spark, "a"), path, NAME)
    assert states(spark, path)["a"][0] == "prepared" and {r.status for r in delivery.ledger(spark, path).collect()} >= {"the payload does not match its hash"}
    place.write_text(json.dumps(body))
    delivery.deliver(items(spark, "a"), path, NAME)
    assert states(spark, path)["a"] == ("completed", 3)
    delivery.deliver(items(spark, "../x"), path, NAME)  # no file has such a name, and nothing is sent
    assert states(spark, path)["../x"] == ("prepared", 1) and "../x" not in {c[2] for c in told()}


def test_slow_and_failed_operations(spark, tmp_path, rules):
    path = str(tmp_path)
    rules(slow=["a"], fail=["b"])
    delivery.deliver(items(spark, "a", "b"), path, NAME)
    assert states(spark, path) == {"a": ("submitted", 1), "b": ("prepared", 1)} and pending(path) == ["a", "b"]
    rules()
    delivery.deliver(items(spark, "a", "b"), path, NAME)
    # the one is only polled, the other sent again
    assert states(spark, path) == {"a": ("completed", 2), "b": ("completed", 2)}
    assert sorted(c[2] for c in told() if c[0] == "POST") == ["a", "b", "b"]


def test_repairs_are_guarded(spark, tmp_path, rules):
    path = str(tmp_path)
    rules(remote={"d-a": "old", "d-b": "strange"})
    given = items(spark, "a", "b", "c", repair=True, acknowledged="old")
    delivery.deliver(given, path, NAME)
    assert {s for s, _ in states(spark, path).values()} == {"prepared"} and not [c for c in told() if c[0] != "GET"]
    delivery.deliver(given, path, NAME, repair=True)
    assert {k: s for k, (s, _) in states(spark, path).items()} == {"a": "completed", "b": "prepared", "c": "completed"}
    assert [c[1] for c in told() if c[0] == "DELETE"] == ["/documents/d-a"]


def test_stream_restarts_and_compaction(spark, tmp_path, rules):
    path, source = str(tmp_path / "ledger"), tmp_path / "in"
    stream = lambda: spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = lambda: delivery.deliver_stream(stream(), path, NAME, str(tmp_path / "cp"), inflight=2).awaitTermination()
    for k, names in enumerate((["a", "b"], ["b", "c"], ["c", "d"])):
        items(spark, *names).coalesce(1).write.mode("append").parquet(str(source))
        if k == 1:
            rules(crash=["c"])
            with pytest.raises(Exception, match="machine is gone"):
                run()
            rules()
        run()
    assert {k: s for k, (s, _) in states(spark, path).items()} == dict.fromkeys("abcd", "completed")
    assert delivery.ledger(spark, path).where("state = 'completed'").count() == 4
    before = states(spark, path)
    assert delivery.compact(spark, path) > 1 and states(spark, path) == before
    delivery.deliver(items(spark, "a", "e"), path, NAME)
    assert states(spark, path) == before | {"e": ("completed", 1)}
