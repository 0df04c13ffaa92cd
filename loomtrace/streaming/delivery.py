"""Delivery of documents to the remote service, with one completed row an operation whatever fails.

The sink is a Python data source.  A task works through the states of its operations:

* ``prepared``: the payload is stored under its operation before anything is sent.  From
  then on it belongs to the operation; a later row of it is not looked at;
* ``ready``: for a repair, the remote document has the acknowledged content and is gone;
* ``submitted``: the service has taken the payload.  Such an operation is polled, and sent
  again only if the service does not know it;
* ``completed``: the service is done; the payload goes.

A task writes what it did into a part of its own and tells the driver its name.  The
driver's commit is one file that names the parts of a batch, so a batch counts whole or
not at all; an abort removes the parts.  What was sent but never committed is found by
its payload and sent again under the same operation id, which the service knows.  A
failed attempt is a row of the ledger like any other and does not hide what comes later.

Every file is read and written through its URI, so the folder can be in any store that
all executors reach.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..sources.files import Folder
from ..sources.remote import Fetch, call, resolve

# States of an operation, from first to last; what ended without success; what was taken.
STATES = ("prepared", "ready", "submitted", "completed")
ENDED = ("failed", "cancelled", "error")
#: Operations that a task looks up and works on at a time.
CHUNK = 64
LEDGER = "operation_id string, document_id string, canonical_hash string, state string, status string, attempt string, at bigint"
_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in LEDGER.split(", ")])


class Written(WriterCommitMessage):
    """The part that a task wrote."""

    def __init__(self, part: str | None, rows: int):
        self.part, self.rows = part, rows


class Item(NamedTuple):
    """One operation as it is stored: what is sent, and what it must hash to."""

    operation_id: str
    document_id: str
    canonical_hash: str
    item: str
    repair: bool = False
    acknowledged_hash: str | None = None


class Ledger(Folder):
    """The files of a ledger."""

    def parts(self) -> list[str]:
        """Names of the parts that commits name.  A commit that replaces others counts in their place."""
        commits = {name: json.loads(self.get(f"commits/{name}")) for name in self.names("commits", ".json")}
        gone = {old for c in commits.values() for old in c["replaces"]}
        return sorted(p for name, c in commits.items() if name not in gone for p in c["parts"])

    def known(self, parts: list[str], operations: list[str]) -> dict[str, str]:
        """State of each of some operations, as committed parts have it."""
        if not parts:
            return {}
        files = ds.dataset([f"{self.root}/parts/{p}" for p in parts], schema=_SCHEMA, filesystem=self.fs, format="parquet")
        found = files.to_table(columns=["operation_id", "state"], filter=ds.field("operation_id").isin(operations))
        out: dict[str, str] = {}
        for op, state in zip(*(c.to_pylist() for c in found.columns), strict=True):
            out[op] = max(out.get(op, STATES[0]), state, key=STATES.index)
        return out


def _payload(operation_id: str) -> str:
    if not operation_id.replace("-", "").isalnum():
        raise ValueError("not an operation id")
    return f"pending/{hashlib.sha256(operation_id.encode()).hexdigest()[:2]}/{operation_id}.json"


def save(folder: Folder, item: Item) -> None:
    folder.put(_payload(item.operation_id), json.dumps(item._asdict()).encode())


def load(folder: Folder, operation_id: str, expected: str) -> Item | None:
    """The stored payload of an operation, if there is one; content of another hash is an error."""
    body = folder.get(_payload(operation_id))
    if body is None:
        return None
    found = Item(**json.loads(body))
    content = json.loads(found.item).get("content") or ""
    if found.canonical_hash != expected or hashlib.sha256(content.encode()).hexdigest() != expected:
        raise ValueError("the payload does not match its hash")
    return found


def advance(folder: Folder, fetch: Fetch, item: Item, state: str | None, repairing: bool) -> Iterator[tuple[str, str]]:
    """States that an operation reaches from ``state`` on, each with what the service said."""
    op = item.operation_id
    if state == "submitted":
        reply = call(fetch, "GET", f"/operations/{op}")
        if reply is not None:
            yield from _polled(folder, op, reply)
            return
    try:
        stored = load(folder, op, item.canonical_hash)
        if stored is None:
            save(folder, item)
            stored = load(folder, op, item.canonical_hash)
    except ValueError as e:
        yield "prepared", str(e)
        return
    if stored.repair:
        if not repairing:
            yield "prepared", "a repair needs a reviewed plan"
            return
        remote = call(fetch, "GET", f"/documents/{stored.document_id}")
        if remote is not None and remote.get("content_hash") not in (stored.acknowledged_hash, stored.canonical_hash):
            yield "prepared", "the remote document changed outside of the repair"
            return
        if remote is not None:
            call(fetch, "DELETE", f"/documents/{stored.document_id}")
        yield "ready", ""
    reply = call(fetch, "POST", "/memories", {"items": [json.loads(stored.item)], "async": True, "operation_id": op}) or {}
    if reply.get("operation_id") not in (None, op):
        yield "prepared", "another operation id came back"
        return
    yield "submitted", "accepted"
    reply = call(fetch, "GET", f"/operations/{op}")
    if reply is not None:
        yield from _polled(folder, op, reply)


def _polled(folder: Folder, op: str, reply: dict) -> Iterator[tuple[str, str]]:
    status = reply.get("status") or "pending"
    if status == "completed":
        folder.drop(_payload(op))
        yield "completed", status
    else:
        # what ended without success is prepared still, so it is sent again
        yield ("prepared" if status in ENDED else "submitted"), status


class _Task:
    """The work of one task of a batch."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def run(self, rows: Iterator, label: str) -> Written:
        folder, fetch = Ledger(self.options["path"]), resolve(self.options["fetch"])
        repairing, parts = self.options.get("repair") == "true", folder.parts()
        attempt, out, seen = uuid.uuid4().hex, [], set()
        while chunk := list(islice(rows, CHUNK)):
            known = folder.known(parts, [r.operation_id for r in chunk])
            for r in chunk:
                if r.operation_id in seen or known.get(r.operation_id) == "completed":
                    continue
                seen.add(r.operation_id)
                given = r.asDict()
                item = Item(r.operation_id, r.document_id, r.canonical_hash, r.item, bool(given.get("repair")), given.get("acknowledged_hash"))
                state, status = "prepared", ""
                try:
                    for state, status in advance(folder, fetch, item, known.get(r.operation_id), repairing):  # noqa: B007
                        pass
                except ConnectionError as e:  # it stays where it has come to
                    status = str(e)
                out.append((r.operation_id, r.document_id, r.canonical_hash, state, status, attempt, len(seen)))
        if not out:
            return Written(None, 0)
        name = f"{label}-{attempt}.parquet"
        sink = pa.BufferOutputStream()
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA), sink)
        folder.put(f"parts/{name}", sink.getvalue().to_pybytes())
        return Written(name, len(out))


def _commit(options: dict[str, str], messages: list, label: str) -> None:
    parts = [m.part for m in messages if m is not None and m.part]
    if parts:
        Ledger(options["path"]).put(f"commits/{label}-{uuid.uuid4().hex}.json", json.dumps({"parts": parts, "replaces": []}).encode())


def _abort(options: dict[str, str], messages: list) -> None:
    for m in messages:
        if m is not None and m.part:
            Ledger(options["path"]).drop(f"parts/{m.part}")


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator) -> Written:
        return _Task(self.options).run(iterator, "part")

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        _commit(self.options, messages, f"{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        _abort(self.options, messages)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator) -> Written:
        return _Task(self.options).run(iterator, "part")

    def commit(self, messages: list) -> None:
        _commit(self.options, messages, "batch")

    def abort(self, messages: list) -> None:
        _abort(self.options, messages)


class Delivery(DataSource):
    """``write.format("delivery")`` with the options ``path`` (the ledger), ``fetch`` (``module:function``) and ``repair``."""

    @classmethod
    def name(cls) -> str:
        return "delivery"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def _writer(items: DataFrame, how, path: str, fetch: str, repair: bool, inflight: int):
    items.sparkSession.dataSource.register(Delivery)
    return how.format("delivery").option("path", path).option("fetch", fetch).option("repair", str(repair).lower()).option("inflight", inflight)


def deliver(items: DataFrame, path: str, fetch: str, repair: bool = False, inflight: int = 4) -> None:
    """Work on the operations of a table: ``operation_id``, ``document_id``, ``canonical_hash``, ``item`` and, for repairs, ``repair``, ``acknowledged_hash``.

    An operation goes to one task, at most ``inflight`` tasks at a time.
    """
    dealt = items.repartition(inflight, "operation_id")
    _writer(dealt, dealt.write, path, fetch, repair, inflight).mode("append").save()


def deliver_stream(items: DataFrame, path: str, fetch: str, checkpoint: str, repair: bool = False, inflight: int = 4, seconds: int | None = None):
    """The same for a stream, as a query: every so many seconds (None: once over what is there)."""
    dealt = items.repartition(inflight, "operation_id")
    writer = _writer(dealt, dealt.writeStream, path, fetch, repair, inflight).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All committed attempts."""
    folder = Ledger(path)
    parts = folder.parts()
    if not parts:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*[f"{path}/parts/{p}" for p in parts])


def operations(attempts: DataFrame) -> DataFrame:
    """``operation_id``, ``state``, ``attempts``: one row an operation, with the furthest state that it has reached."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    best = attempts.groupBy("operation_id").agg(F.max(rank).alias("r"), F.countDistinct("attempt").alias("attempts"))
    return best.select("operation_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("r").cast("int")).alias("state"), "attempts")


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite the parts as few; how many there were.  Attempts stay, sorted by operation, so a lookup reads little of a part.

    The new parts count from the one file on that names them and the commits that they
    replace; not to be run beside a delivery.
    """
    folder = Ledger(path)
    commits, parts = folder.names("commits", ".json"), folder.parts()
    if len(parts) < 2:
        return len(parts)
    name = f"base-{uuid.uuid4().hex}"
    ledger(spark, path).repartitionByRange("operation_id").sortWithinPartitions("operation_id").write.parquet(f"{path}/parts/{name}")
    made = [f"{name}/{n}" for n in folder.names(f"parts/{name}", ".parquet")]
    folder.put(f"commits/{name}.json", json.dumps({"parts": made, "replaces": commits}).encode())
    for old in commits:
        folder.drop(f"commits/{old}")
    folder.put(f"commits/{name}.json", json.dumps({"parts": made, "replaces": []}).encode())
    for old in parts:
        folder.drop(f"parts/{old}")
    return len(parts)
