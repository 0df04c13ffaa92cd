"""A stream of the changes of mutable files: a file that is appended to, rewritten or removed comes again, whole.

Spark's own file source sees a path once.  Here an offset is the digest of a listing:
path, size, modification time and fingerprint of every file.  A batch is what differs
between two listings.  Listings are kept beside the query's checkpoint, so that a restart
finds the one that its last offset names; those that a finished batch has left behind go.

A file whose time changes but whose fingerprint does not is no change.  Only files with
another size or time are looked into when a listing is made, several at a time, and only
at their ends, and a listing takes in at most ``max_files`` changes.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import Folder
from .jsonl import SAMPLE, read_sample_hash

CHANGE = "path string, change string, size bigint, modified_ns bigint, fingerprint string, content binary"
_LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("fingerprint", pa.string())])
#: Bytes of the files of a task, and threads that look into files.
TASK_BYTES, THREADS = 64 << 20, 16


class Seen(NamedTuple):
    """What a listing says of a file."""

    size: int
    modified: int
    fingerprint: str


class _Task(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files  # path and kind of change


def _ends(fs: pyarrow.fs.FileSystem, path: str, size: int) -> str | None:
    """The fingerprint of a file, from its two ends alone; None if it is gone."""
    try:
        with fs.open_input_file(path) as f:
            head = f.read_at(min(SAMPLE, size), 0)
            tail = f.read_at(min(SAMPLE, size), max(0, size - SAMPLE))
    except FileNotFoundError:
        return None
    return hashlib.sha256(head + tail + str(size).encode()).hexdigest()


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.files, self.state = Folder(options["path"]), Folder(options["state"])
        self.pattern, self.most = options.get("pattern", "*.jsonl"), int(options.get("max_files", "1000"))

    # -- listings, by number and digest

    def _load(self, offset: dict) -> dict[str, Seen]:
        if offset["n"] == 0:
            return {}
        body = self.state.get(f"listings/{offset['n']:012d}-{offset['digest']}.parquet")
        if body is None:
            raise FileNotFoundError(f"the listing of offset {json.dumps(offset)} is gone")
        t = pq.read_table(pa.BufferReader(body))
        return {p: Seen(*rest) for p, *rest in zip(*(c.to_pylist() for c in t.columns), strict=True)}

    def _last(self) -> dict:
        names = self.state.names("listings", ".parquet")
        if not names:
            return self.initialOffset()
        n, _, digest = names[-1].removesuffix(".parquet").partition("-")
        return {"n": int(n), "digest": digest}

    def _store(self, n: int, listing: dict[str, Seen]) -> dict:
        rows = sorted((p, *s) for p, s in listing.items())
        digest = hashlib.sha256(json.dumps(rows).encode()).hexdigest()[:32]
        table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _LISTING.types, strict=True)], schema=_LISTING)
        sink = pa.BufferOutputStream()
        pq.write_table(table, sink)
        self.state.put(f"listings/{n:012d}-{digest}.parquet", sink.getvalue().to_pybytes())
        return {"n": n, "digest": digest}

    # -- offsets

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0, "digest": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = self._last()
        known = self._load(last)
        found = {i.path: i for i in self.files.fs.get_file_info(pyarrow.fs.FileSelector(self.files.root, recursive=True, allow_not_found=True)) if i.type == pyarrow.fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)}
        touched = sorted(p for p, i in found.items() if p not in known or known[p][:2] != (i.size, i.mtime_ns))
        gone = sorted(known.keys() - found.keys())
        new, changes = dict(known), 0
        for p in gone[: self.most]:
            del new[p]
            changes += 1
        with ThreadPoolExecutor(THREADS) as pool:
            at = 0
            while at < len(touched) and changes < self.most:
                part = touched[at : at + self.most - changes]
                for p, mark in zip(part, pool.map(lambda p: _ends(self.files.fs, p, found[p].size), part), strict=True):
                    if mark is not None:
                        changes += p not in known or known[p].fingerprint != mark
                        new[p] = Seen(found[p].size, found[p].mtime_ns, mark)
                at += len(part)
        # times alone are taken in with the next change
        return self._store(last["n"] + 1, new) if changes else last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start == end:
            return []
        old, new = self._load(start), self._load(end)
        changed = [(p, "changed" if p in old else "added", s.size) for p, s in sorted(new.items()) if p not in old or old[p].fingerprint != s.fingerprint]
        changed += [(p, "removed", 0) for p in sorted(old.keys() - new.keys())]
        tasks, held, size = [], [], 0
        for path, change, n in changed:
            if held and size + n > TASK_BYTES:
                tasks.append(_Task(held))
                held, size = [], 0
            held.append((path, change))
            size += n + 4096
        return [*tasks, _Task(held)] if held else tasks

    def read(self, partition: _Task) -> Iterator[tuple]:
        """Changed files as they are now.  One that went meanwhile is left to the batch that sees it gone."""
        for path, change in partition.files:
            if change == "removed":
                yield path, change, None, None, None, None
                continue
            try:
                info = self.files.fs.get_file_info(path)
                with self.files.fs.open_input_stream(path) as f:
                    content = f.read()
            except FileNotFoundError:
                continue
            yield path, change, len(content), info.mtime_ns, read_sample_hash(content), content

    def commit(self, end: dict) -> None:
        for name in self.state.names("listings", ".parquet"):
            if int(name.partition("-")[0]) < end["n"]:
                self.state.drop(f"listings/{name}")


class FileChanges(DataSource):
    """``readStream.format("file_changes")`` with ``path``, ``state`` (a folder of the query), ``pattern`` and ``max_files``."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


def changes(spark: SparkSession, path: str, state: str, pattern: str = "*.jsonl", max_files: int = 1000) -> DataFrame:
    """``path``, ``change`` (added, changed, removed), ``size``, ``modified_ns``, ``fingerprint``, ``content`` of files as they change.

    ``path`` and ``state`` are folders that the driver and all executors reach.  Content is
    whole; its last line may be torn, and reading it as JSON lines leaves that line to the
    batch that completes it.  A removed file has no content.
    """
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("path", path).option("state", state).option("pattern", pattern).option("max_files", max_files).load()
