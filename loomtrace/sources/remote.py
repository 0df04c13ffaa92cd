"""The remote service: paged listings as a data source, and documents sent to it.

The service is a function ``fetch(method, route, body) -> (status, reply)``, named as
``module:function`` so that every executor can import it.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import columns as C
from ..settings import RETAIN, retry_delay_ms

PAGE = 100
#: Name of the rows in the reply of each listing.
LISTINGS = {"documents": "items", "operations": "operations"}
Fetch = Callable[[str, str, dict | None], tuple[int, dict | None]]


def resolve(name: str) -> Fetch:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def call(fetch: Fetch, method: str, route: str, body: dict | None = None, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """One request, tried again while its reply asks for it; a missing thing is None, another refusal an error."""
    for attempt in range(attempts):
        try:
            status, reply = fetch(method, route, body)
        except OSError:
            status, reply = None, None
        if status is not None and status < 400:
            return reply
        if status == 404 and method in ("GET", "DELETE"):
            return None
        wait = retry_delay_ms(attempt, status, (reply or {}).get("retry_after"))
        if wait is None or attempt + 1 == attempts:
            raise ConnectionError(f"{method} {route}: {status if status is not None else 'no reply'}")
        sleep(wait / 1000)
    return None


def pages(fetch: Fetch, listing: str, offset: int = 0, stop: int | None = None, status: str | None = None) -> Iterator[dict]:
    """Rows of a listing from an offset on, until a short page, the total, or ``stop``."""
    while stop is None or offset < stop:
        extra = f"&status={status}" if status else ""
        reply = call(fetch, "GET", f"/{listing}?limit={PAGE}&offset={offset}{extra}") or {}
        rows = reply.get(LISTINGS[listing]) or []
        yield from rows
        offset += PAGE
        if len(rows) < PAGE or (reply.get("total") is not None and offset >= reply["total"]):
            return


class _Span(InputPartition):
    def __init__(self, start: int, stop: int | None):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    """Offset ranges, one partition each, if the service tells a total; else one partition reads on."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        reply = call(resolve(self.options["fetch"]), "GET", f"/{self.options['listing']}?limit=1&offset=0" + (f"&status={s}" if (s := self.options.get("status")) else "")) or {}
        if reply.get("total") is None:
            return [_Span(0, None)]
        step = PAGE * max(1, -(-reply["total"] // (PAGE * int(self.options.get("partitions", "8")))))
        # the last range reads on, over what came meanwhile
        starts = list(range(0, max(reply["total"], 1), step))
        return [_Span(a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]

    def read(self, span: _Span) -> Iterator[tuple]:
        for row in pages(resolve(self.options["fetch"]), self.options["listing"], span.start, span.stop, self.options.get("status")):
            yield (json.dumps(row),)


class RemoteSource(DataSource):
    """``spark.read.format("remote_listing")``: one JSON row a remote document or operation."""

    @classmethod
    def name(cls) -> str:
        return "remote_listing"

    def schema(self) -> str:
        return "row string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def listing(spark: SparkSession, fetch: str, what: str, schema: str, status: str | None = None, partitions: int = 8) -> DataFrame:
    """Remote documents or operations as a table."""
    spark.dataSource.register(RemoteSource)
    reader = spark.read.format("remote_listing").option("fetch", fetch).option("listing", what).option("partitions", partitions)
    raw = reader.option("status", status).load() if status else reader.load()
    return raw.select(F.from_json("row", schema).alias("r")).select("r.*").distinct()  # ranges of a list that changes may overlap


METADATA = ("source", "native_session_id", "source_path", "cwd", "title", "parent_session_id", "project_id", "agent", "model", "canonical_schema", "adapter_version", "redaction_policy_version")


def retain_items(documents: DataFrame) -> DataFrame:
    """``operation_id``, ``document_id``, ``canonical_hash`` and ``item``, the JSON to send.

    ``documents`` has those keys, ``content``, ``started_at`` and what it has of the
    metadata; metadata are strings, redacted, and absent where null.
    """
    named: dict[str, Column] = {c: F.col(c).cast("string") for c in METADATA if c in documents.columns}
    named |= {"canonical_hash": F.col("canonical_hash"), "retain_policy_version": F.lit(RETAIN)}
    metadata = F.struct(*[C.redact(v).alias(k) for k, v in named.items()])
    tags = F.array(F.concat(F.lit("source:"), F.col("source")), F.concat(F.lit("schema:"), F.col("canonical_schema") if "canonical_schema" in documents.columns else F.lit("")))
    item = F.struct(
        "content", F.concat(F.lit("Global coding-agent session from "), F.col("source")).alias("context"), "document_id", F.lit("replace").alias("update_mode"), F.col("started_at").alias("timestamp"),
        F.lit("conversation").alias("strategy"), tags.alias("tags"), F.lit("shared").alias("observation_scopes"), metadata.alias("metadata"),
    )
    return documents.select("operation_id", "document_id", "canonical_hash", F.to_json(item).alias("item"))


def retain_writer(fetch: str, path: str, inflight: int = 4):
    """A ``foreachBatch`` sink: items are delivered under the ledger in ``path``, each operation to completion and once."""
    from ..streaming.delivery import deliver

    def write(batch: DataFrame, batch_id: int) -> None:
        deliver(batch, path, fetch, inflight=inflight)

    return write
