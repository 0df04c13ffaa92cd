"""Session logs of four agents -> canonical sessions with their turns.

A session file has an open schema that changes from record to record, and whether an
answer drew on memory depends on the records before it; so files are folded one by one
in Arrow batches (a file is a row, the number of files sets the parallelism).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sqlite3
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from ..functions import columns as C
from ..functions import plain as P
from ..functions.constants import EPOCH
from ..operators.canonical import checkpoint
from ..schemas import LOADED
from . import classify, jsonl


class _Turns:
    """Turns of a session, with the memory state that runs along its branches."""

    def __init__(self) -> None:
        self.turns: list[dict] = []
        self.pending: dict[str, bool] = {}
        self.previous = False

    def before(self, parent: str | None) -> bool:
        return self.pending.get(parent, False) if parent else self.previous

    def after(self, entry: str, pending: bool) -> None:
        self.pending[entry] = self.previous = pending

    def add(self, role: str, text: str, at: str, entry: str, parent: str | None, provenance: str | None = None) -> bool:
        text = P.normalize_text(text)
        if role == "user":
            text = P.strip_harness(text)
        text = P.redact(P.strip_injected(text))[0]
        if text:
            self.turns.append({"seq": len(self.turns) + 1, "role": role, "content": text, "timestamp": at, "native_entry_id": entry, "parent_entry_id": parent, "provenance": provenance})
        return bool(text)

    def message(self, role: str, content: object, at: str, entry: str, parent: str | None, pending: bool, user_tools: bool) -> bool:
        """A message's texts and tool calls; the memory state after it."""
        provenance = "memory-assisted" if pending else "original"
        for text in P.text_parts(content):
            if self.add(role, text, at, entry, parent, provenance if role == "assistant" else None) and role == "user":
                pending = False
        if role == "assistant" or user_tools:
            blocks = P.tool_blocks(content)
            for name, given in blocks:
                self.add("action", P.action_text(name, given), at, entry, parent)
            if P.calls_memory(content) or any(name in P.MEMORY_TOOLS for name, _ in blocks):
                pending = True
        return pending


def _object(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _role(value: object) -> str:
    return (P.text_or_none(value) or "").lower()


def _latest(started: str, times: Iterator[str]) -> str:
    return max([started, *times])


def parse_pi(path: str, root: str, lines: list[jsonl.Line], label: str | None) -> dict:
    head = _object(lines[0].value) if lines else {}
    started = P.iso(head.get("timestamp"), P.file_timestamp("pi", os.path.basename(path)))
    names = [_object(x.value).get("name") for x in lines if _object(x.value).get("type") == "session_info"]
    t, times = _Turns(), []
    for line in lines:
        e = _object(line.value)
        entry, parent = P.text_or_none(e.get("id")) or f"line:{line.number}", P.text_or_none(e.get("parentId"))
        pending, at = t.before(parent), P.iso(e.get("timestamp"), started)
        times.append(at)
        message = e.get("message")
        if _role(e.get("type")) == "message" and isinstance(message, dict) and (role := _role(message.get("role"))) in ("user", "assistant"):
            pending = t.message(role, message.get("content"), at, entry, parent, pending, user_tools=False)
        t.after(entry, pending)
    name, parent = P.text_or_none(names[-1]) if names else None, P.text_or_none(head.get("parentSession"))
    relative = os.path.relpath(path, root)
    relative = relative.replace(os.sep, "/")
    verdict = classify.verdict("pi", {"legacy": classify.found(classify.LEGACY_NAME, name), "generated": classify.found(classify.GENERATED_NAME, name), "nested": classify.found(classify.CHILD_LAYOUT, relative, any_case=False), "task": classify.found(classify.TASK_LAYOUT, relative, any_case=False), "parent": parent})
    return {"id": P.text_or_none(head.get("id")), "started": started, "updated": _latest(started, iter(times)), "cwd": P.text_or_none(head.get("cwd")), "title": name, "verdict": verdict, "parent": parent, "turns": t.turns}


def parse_codex(path: str, root: str, lines: list[jsonl.Line], label: str | None) -> dict:
    first = _object(lines[0].value) if lines else {}
    recognized = _role(first.get("type")) == "session_meta" and isinstance(first.get("payload"), (dict, list))
    head = _object(first.get("payload"))
    stamp = first.get("timestamp") if first.get("timestamp") is not None else head.get("timestamp")
    started = P.iso(stamp, P.file_timestamp("codex", os.path.basename(path)))
    t, times, seen, pending = _Turns(), [], set(), False
    for line in lines:
        r = _object(line.value)
        at = P.iso(r.get("timestamp"), started)
        times.append(at)
        p = _object(r.get("payload"))
        kind = _role(p.get("type"))
        if _role(r.get("type")) != "response_item":
            continue
        entry = P.text_or_none(p.get("id")) or P.text_or_none(r.get("id")) or f"line:{line.record}"
        parent = P.text_or_none(p.get("parent_id")) or P.text_or_none(p.get("parentId"))
        if kind == "message" and (role := _role(p.get("role"))) in ("user", "assistant"):
            key = (role, json.dumps(p.get("content")), at)
            if key in seen:
                continue
            seen.add(key)
            pending = t.message(role, p.get("content"), at, entry, parent, t.before(parent), user_tools=True)
        elif kind in ("function_call", "custom_tool_call", "local_shell_call", "web_search_call"):
            name = P.text_or_none(p.get("name")) or P.text_or_none(p.get("tool_name")) or kind
            given = next((p[k] for k in ("arguments", "input", "parameters") if p.get(k) is not None), p)
            t.add("action", P.action_text(name, given), at, entry, parent)
            pending = pending or name in P.MEMORY_TOOLS
        else:
            continue
        t.after(entry, pending)
    source, thread = head.get("source"), _role(head.get("thread_source"))
    sub = source == "subagent" or thread == "subagent" or (isinstance(source, dict) and source.get("subagent") is not None)
    parent = P.text_or_none(head.get("parent_thread_id"))
    name = source.lower() if isinstance(source, str) else None
    marked = parent or P.text_or_none(head.get("agent_role")) or P.text_or_none(head.get("agent_nickname"))
    verdict = classify.verdict("codex", {"unrecognized": not recognized, "explicit": sub, "marked": marked, "object_source": isinstance(source, dict), "odd_thread": thread and thread != "user", "odd_source": name and name not in ("exec", "cli")})
    return {"id": P.text_or_none(head.get("id")) or P.text_or_none(head.get("session_id")), "started": started, "updated": _latest(started, iter(times)), "cwd": P.text_or_none(head.get("cwd")), "title": label, "verdict": verdict, "parent": parent, "turns": t.turns}


def parse_claude(path: str, root: str, lines: list[jsonl.Line], label: str | None) -> dict:
    head = _object(lines[0].value) if lines else {}
    started = P.iso(head.get("timestamp"), P.file_timestamp("claude", os.path.basename(path)))
    t, times = _Turns(), []
    for line in lines:
        r = _object(line.value)
        at = P.iso(r.get("timestamp"), started)
        times.append(at)
        message = _object(r.get("message"))
        role = _role(message.get("role"))
        skipped = r.get("isSidechain") is True or r.get("isMeta") is True or _role(r.get("type")) in ("progress", "file-history-snapshot", "queue-operation", "system", "summary")
        if skipped or role not in ("user", "assistant"):
            continue
        entry, parent = P.text_or_none(r.get("uuid")) or f"line:{line.record}", P.text_or_none(r.get("parentUuid"))
        t.after(entry, t.message(role, message.get("content"), at, entry, parent, t.before(parent), user_tools=True))
    agent = P.text_or_none(head.get("agentId"))
    posix = path.replace(os.sep, "/")
    placed = classify.found(classify.AGENT_FILE, posix, any_case=False) or "/subagents/" in posix.lower()
    verdict = classify.verdict("claude", {"sidechain": head.get("isSidechain") is True, "agent": agent, "placed": placed})
    return {"id": P.text_or_none(head.get("sessionId")), "started": started, "updated": _latest(started, iter(times)), "cwd": P.text_or_none(head.get("cwd")), "title": None, "verdict": verdict, "parent": None, "turns": t.turns}


PARSERS: dict[str, Callable[..., dict]] = {"pi": parse_pi, "codex": parse_codex, "claude": parse_claude}


def load_session(source: str, path: str, root: str, content: bytes, label: str | None = None, max_bytes: int = 100 << 20) -> dict:
    """One session file as a row of ``schemas.LOADED``; a failure is a row with its status and error."""
    sample = jsonl.read_sample_hash(content)
    row = {"source": source, "locator": path, "size": len(content), "sample_hash": jsonl.with_label(sample, label), "turns": []}
    try:
        got = PARSERS[source](path, root, jsonl.read_lines(content), label)
        session = got["id"] or P.fallback_id(source, os.path.relpath(path, root), got["started"])
        doc = P.document_id(source, session)
        first = {"seq": 0, "role": "system", "content": f"REF-ID: {doc}", "timestamp": got["started"], "native_entry_id": None, "parent_entry_id": None, "provenance": None}
        turns = [first, *got["turns"]]
        if (n := sum(len(P.canonical_line(t).encode()) + 1 for t in turns)) > max_bytes:
            raise ValueError(f"canonical document of {n} exceeds {max_bytes} bytes")
        kind, reason = got["verdict"]
        row |= {"native_session_id": session, "document_id": doc, "started_at": got["started"], "updated_at": got["updated"], "title": got["title"], "cwd": got["cwd"], "turns": turns}
        row |= {"classification": {"kind": kind, "reason": reason, "label": got["title"], "parent_session_id": got["parent"]}, "status": "discovered" if len(turns) > 1 else "empty_after_normalization"}
    except ValueError as e:
        row |= {"error": str(e), "status": "too_large" if "exceeds" in str(e) else "malformed" if "JSON" in str(e) else "error"}
    return row


_ARROW = pa.schema(
    [(c, pa.string()) for c in ("source", "native_session_id", "document_id", "locator", "started_at", "updated_at", "title", "cwd")]
    + [("classification", pa.struct([(c, pa.string()) for c in ("kind", "reason", "label", "parent_session_id")])), ("sample_hash", pa.string()), ("size", pa.int64()), ("error", pa.string()), ("status", pa.string())]
    + [("turns", pa.list_(pa.struct([("seq", pa.int32())] + [(c, pa.string()) for c in ("role", "content", "timestamp", "native_entry_id", "parent_entry_id", "provenance")])))]
)


def read_sessions(spark: SparkSession, source: str, root: str, labels: DataFrame | None = None, max_bytes: int = 100 << 20, pattern: str = "*.jsonl") -> DataFrame:
    """Sessions of one source below a folder, from the files whose names fit a pattern.

    ``labels`` (id, name, title) names Codex sessions: by the thread's id, else by the
    session's, as the header has them; a label takes part in the fingerprint.
    """
    root = re.sub("^file:/*", "/", root.rstrip("/"))
    found = jsonl.files(spark, root, pattern).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    if labels is None:
        found = found.withColumn("label", F.lit(None).cast("string"))
    else:
        head = F.try_parse_json(jsonl.first_line(F.col("content")))
        for name, field in (("_thread", "session_id"), ("_id", "id")):
            found = found.withColumn(name, F.try_variant_get(head, f"$.payload.{field}", "string"))
        named = labels.select(C.text_or_null(F.col("id")).alias("id"), F.coalesce(C.text_or_null(F.col("name")), C.text_or_null(F.col("title"))).alias("label")).where("id is not null and label is not null")
        named = named.groupBy("id").agg(F.max("label").alias("label"))
        for name in ("_thread", "_id"):
            found = found.join(named.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label")), name, "left")
        found = found.withColumn("label", F.coalesce("_thread_label", "_id_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pylist([load_session(source, path, root, content, label, max_bytes)], schema=_ARROW)

    return found.select("path", "content", "label").mapInArrow(run, LOADED)


# -- sessions in a SQLite database


class _Part(InputPartition):
    def __init__(self, path: str, low: str | None, high: str | None):
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    """Ranges of session ids, one partition each, over read-only connections.

    A partition reads its sessions, their messages and their parts by one ordered scan
    each, and merges the three by session.
    """

    def __init__(self, path: str, partitions: int):
        self.path, self.n = path, partitions
        self.tests: list[tuple[str, list[str]]] = []

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def _where(self, column: str, part: _Part | None = None) -> tuple[str, list]:
        tests = [(t.format(id=column), v) for t, v in self.tests]
        if part and part.low is not None:
            tests.append((f"{column} >= ?", [part.low]))
        if part and part.high is not None:
            tests.append((f"{column} < ?", [part.high]))
        return " AND ".join(t for t, _ in tests) or "1", [x for _, v in tests for x in v]

    def partitions(self) -> list[InputPartition]:
        where, values = self._where("id")
        with self._open() as db:
            total = db.execute(f"SELECT count(*) FROM session WHERE {where}", values).fetchone()[0]
            step = max(1, -(-total // self.n))
            edges = [r[0] for r in db.execute(f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM session WHERE {where}) WHERE (n - 1) % {step} = 0 AND n > 1 ORDER BY id", values)]
        return [_Part(self.path, a, b) for a, b in zip([None, *edges], [*edges, None], strict=True)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        with self._open() as db:
            db.execute("BEGIN")  # one snapshot for sessions, messages and parts
            have = self._columns(db, "session")
            columns = ", ".join(c if c in have else f"NULL AS {c}" for c in SESSION_COLUMNS)
            capable = {"parent_id", "title"} <= have
            where, values = self._where("id", part)
            sessions = db.execute(f"SELECT {columns} FROM session WHERE {where} ORDER BY id", values)
            where, values = self._where("m.session_id", part)
            messages = _Groups(db.execute(f"SELECT m.session_id, m.id, m.time_created, {self._updated(db, 'message', 'm')}, m.data FROM message m WHERE {where} ORDER BY m.session_id, m.time_created, m.id", values))
            parts = _Groups(db.execute(f"SELECT m.session_id, p.id, p.time_created, {self._updated(db, 'part', 'p')}, p.data, p.message_id FROM part p JOIN message m ON m.id = p.message_id WHERE {where} ORDER BY m.session_id, p.time_created, p.id", values))
            ids, rows, size = [], [], 0
            for row in sessions:
                said, inside = messages.of(row[0]), parts.of(row[0])
                by_message: dict[str, list] = {}
                for *p, message in inside:
                    by_message.setdefault(message, []).append(p[3])
                print_ = fingerprint(dict(zip(SESSION_COLUMNS, row, strict=True)), said, [p[:4] for p in inside])
                text = json.dumps({"row": row, "capable": capable, "messages": [((m[0], m[1], m[3]), by_message.get(m[0], [])) for m in said], "fingerprint": print_})
                ids.append(row[0])
                rows.append(text)
                size += len(text)
                if size > BATCH_CHARS:
                    yield _batch(ids, rows)
                    ids, rows, size = [], [], 0
            yield _batch(ids, rows)

    def _columns(self, db: sqlite3.Connection, table: str) -> set[str]:
        return {r[1] for r in db.execute(f"PRAGMA table_info({table})")}

    def _updated(self, db: sqlite3.Connection, table: str, name: str) -> str:
        return f"{name}.time_updated" if "time_updated" in self._columns(db, table) else "NULL"


class _Pushing(_Reader):
    """The same, with filters on ``id`` in the scans and in the choice of ranges."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take comparisons of the id with values; the others stay with Spark."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if getattr(f, "attribute", None) != ("id",):
                yield f
            elif type(f) in signs:
                self.tests.append((f"{{id}} {signs[type(f)]} ?", [f.value]))
            elif isinstance(f, In):
                self.tests.append((f"{{id}} IN ({', '.join('?' * len(f.value)) or 'NULL'})", list(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("substr({id}, 1, ?) = ?", [len(f.value), f.value]))
            elif not isinstance(f, IsNotNull):  # an id is never null
                yield f


class _Groups:
    """Rows in the order of their first column, handed out by its values in that order."""

    def __init__(self, rows: Iterator[tuple]):
        self.groups = groupby(rows, key=lambda r: r[0])
        self.next = next(self.groups, None)

    def of(self, key: str) -> list[tuple]:
        """Rows of a key without it; rows of smaller keys belong to nothing and are passed over."""
        while self.next is not None and self.next[0] < key:
            self.next = next(self.groups, None)
        if self.next is None or self.next[0] != key:
            return []
        found = [r[1:] for r in self.next[1]]
        self.next = next(self.groups, None)
        return found


def _batch(ids: list[str], rows: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, pa.string())], ["id", "session"])


#: Characters of the sessions of a batch, about.
BATCH_CHARS = 16 << 20
#: Columns read of a session; those that a database lacks are null.
SESSION_COLUMNS = ("id", "parent_id", "project_id", "directory", "title", "agent", "model", "time_created", "time_updated")


def fingerprint(session: dict, messages: list[tuple], parts: list[tuple]) -> str:
    """SHA-256 over a session row and all its messages and parts, each framed by its size."""
    compact = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()
    h = hashlib.sha256(compact(session))
    for name, rows in (("messages", messages), ("parts", parts)):
        h.update(f"\n{name}\n".encode())
        for id_, created, updated, data in rows:
            body = str(data).encode()
            h.update(compact([id_, created, updated, len(body)]) + b"\0" + body + b"\n")
    return h.hexdigest()


class OpenCodeSource(DataSource):
    """``spark.read.format("opencode_sessions").option("path", ...)``: ``id`` and ``session`` (JSON), a row a session."""

    @classmethod
    def name(cls) -> str:
        return "opencode_sessions"

    def schema(self) -> str:
        return "id string, session string"

    def reader(self, schema) -> DataSourceReader:
        kind = _Pushing if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("partitions", "8")))


def parse_opencode(text: str, path: str) -> dict:
    """One session of the database as a row of ``schemas.LOADED``."""
    got = json.loads(text)
    session, parent, _, cwd, title, _, _, created, updated = got["row"]
    started = P.iso(created, EPOCH)
    t, times = _Turns(), [P.iso(updated, started)]
    row = {"source": "opencode", "native_session_id": session, "document_id": P.document_id("opencode", session), "locator": f"{path}#{session}", "turns": [], "size": 0, "sample_hash": got["fingerprint"]}
    try:
        for (message, at_ms, data), parts in got["messages"]:
            m = json.loads(data)
            role = _role(m.get("role"))
            if role not in ("user", "assistant"):
                continue
            at = P.iso(_object(m.get("time")).get("created") or at_ms, started)
            times.append(at)
            above = P.text_or_none(m.get("parentID")) or P.text_or_none(m.get("parent_id"))
            pending, texts, actions = t.before(above), [], []
            for p in map(json.loads, parts):
                kind = _role(p.get("type"))
                if kind == "text" and P.text_or_none(p.get("text")):
                    texts.append(P.text_or_none(p["text"]))
                elif kind in ("tool", "tool-call", "tool_call"):
                    state = _object(p.get("state"))
                    actions.append((P.text_or_none(p.get("tool")) or P.text_or_none(p.get("name")) or "tool", next((x for x in (p.get("input"), state.get("input"), state.get("raw")) if x is not None), p)))
            provenance = "memory-assisted" if pending else "original"
            for text in texts:
                if t.add(role, text, at, message, above, provenance if role == "assistant" else None) and role == "user":
                    pending = False
            for name, given in actions:
                t.add("action", P.action_text(name, given), at, message, above)
                pending = pending or name in P.MEMORY_TOOLS
            t.after(message, pending)
    except ValueError as e:
        return row | {"status": "malformed", "error": f"malformed JSON: {e}"}
    parent, title = P.text_or_none(parent), P.text_or_none(title)
    verdict = classify.verdict("opencode", {"incapable": not got["capable"], "parent": parent, "generated": classify.found(classify.GENERATED_TITLE, title)})
    doc = row["document_id"]
    first = {"seq": 0, "role": "system", "content": f"REF-ID: {doc}", "timestamp": started, "native_entry_id": None, "parent_entry_id": None, "provenance": None}
    row |= {"started_at": started, "updated_at": max(times), "title": title, "cwd": P.text_or_none(cwd), "turns": [first, *t.turns], "status": "discovered" if t.turns else "empty_after_normalization"}
    return row | {"classification": {"kind": verdict[0], "reason": verdict[1], "label": title, "parent_session_id": parent}}


def read_opencode(spark: SparkSession, path: str, partitions: int = 8, where: Column | None = None) -> DataFrame:
    """Sessions of a SQLite database that all executors can open; ``where``, over ``id``, is a filter for its scans.

    Filters reach the database if ``spark.sql.python.filterPushdown.enabled`` is set, and
    are applied by Spark otherwise.
    """
    spark.dataSource.register(OpenCodeSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    raw = spark.read.format("opencode_sessions").option("path", path).option("partitions", partitions).option("pushdown", pushed).load()
    raw = (raw if where is None else raw.where(where)).select("session")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([parse_opencode(x, path) for x in batch.column(0).to_pylist()], schema=_ARROW)

    return raw.mapInArrow(run, LOADED)


def turns_of(sessions: DataFrame) -> DataFrame:
    """One row a turn."""
    return sessions.select("source", "native_session_id", "document_id", F.explode("turns").alias("t")).select("source", "native_session_id", "document_id", "t.*")


def dead_letters(sessions: DataFrame, at: str) -> DataFrame:
    """Sessions that could not be read, as rows of the table of scan errors, redacted, with their status."""
    return sessions.where("error is not null").select("source", "locator", C.redact(F.col("error")).alias("error"), F.lit(at).alias("observed_at"), C.status_of_error(F.col("error")).alias("status"))


MOVED = "source changed while it was read"


def stable_sessions(first: DataFrame, again: DataFrame) -> DataFrame:
    """Sessions whose fingerprint was the same before and after they were read (``again``: source, locator, sample_hash).

    The others changed meanwhile; they are errors, to be read by the next scan.
    """
    now = again.select("source", "locator", F.col("sample_hash").alias("_now")).distinct()
    got = first.join(now, ["source", "locator"], "left")
    same = F.col("sample_hash").eqNullSafe(F.col("_now"))
    empty = F.array().cast(first.schema["turns"].dataType)
    values = {"error": F.when(same, F.col("error")).otherwise(MOVED), "status": F.when(same, F.col("status")).otherwise("error"), "turns": F.when(same, F.col("turns")).otherwise(empty)}
    return got.select(*[values[c].alias(c) if c in values else F.col(c) for c in first.columns])


def read_stable(load: Callable[[DataFrame | None], DataFrame], look: Callable[[], DataFrame], attempts: int = 2) -> DataFrame:
    """Sessions whose fingerprint stood still while they were read; those that moved are read again, ``attempts`` times in all.

    ``load`` reads sessions (all, or those of ``source``, ``locator``), ``look`` gives the
    fingerprints of now.  What still moves at the last attempt is an error.
    """
    got = checkpoint(stable_sessions(checkpoint(load(None)), look()))
    for _ in range(attempts - 1):
        moved = got.where(F.col("error") == MOVED)
        if not moved.limit(1).count():
            break
        again = checkpoint(load(moved.select("source", "locator")))
        got = checkpoint(got.where(~F.col("error").eqNullSafe(F.lit(MOVED))).unionByName(stable_sessions(again, look())))
    return got
