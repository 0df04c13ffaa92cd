"""Queries of what changes while it is read: deliveries with refusals, files that change, over the driver's tables.

Documents stand for operations and for the records of logs, sources for log files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ORACLE_SQL, QUERIES, query, read
from .operators import canonical
from .sources import changes
from .sources.files import Folder
from .streaming import delivery

__all__ = ["ORACLE_SQL", "QUERIES"]


# -- delivery: three runs over all documents, the service refuses every fifth in the first two


def accepting(method: str, route: str, body: dict | None) -> tuple[int, dict | None]:
    """A service that takes everything."""
    return (200, {"operation_id": body["operation_id"]}) if method == "POST" else (200, {"status": "completed"})


def refusing(method: str, route: str, body: dict | None) -> tuple[int, dict | None]:
    """One that refuses operations whose number five divides."""
    return (400, None) if method == "POST" and int(body["operation_id"]) % 5 == 0 else accepting(method, route, body)


@query("SELECT doc_id, 'completed' AS state, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END::BIGINT AS attempts, 1::BIGINT AS completions FROM documents")
def deliveries(spark, sf_dir):
    """Operations after two runs with refusals and one without: all completed once, none sent again after that."""
    d = read(spark, sf_dir, "documents")
    items = d.select(F.col("doc_id").cast("string").alias("operation_id"), F.concat(F.lit("d-"), "doc_id").alias("document_id"), F.sha2("text", 256).alias("canonical_hash"), F.to_json(F.struct(F.col("text").alias("content"))).alias("item"))
    path = f"{canonical.shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    try:
        for service in ("refusing", "refusing", "accepting"):
            delivery.deliver(items, path, f"{__name__}:{service}", inflight=8)
        attempts = delivery.ledger(spark, path)
        done = attempts.where("state = 'completed'").groupBy("operation_id").agg(F.count("*").alias("completions"))
        found = delivery.operations(attempts).join(done, "operation_id", "left")
        return canonical.checkpoint(found.select(F.col("operation_id").cast("bigint").alias("doc_id"), "state", "attempts", F.coalesce("completions", F.lit(0)).alias("completions")))
    finally:
        canonical.remove_folder(spark, path)


# -- files that change: a log a source, looked at three times


def _write_logs(docs: DataFrame, path: str) -> None:
    """A file a source, with a record a document; what was there is replaced."""
    line = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: F.concat(F.lit('{"n": '), x.cast("string"), F.lit("}\n")))
    rows = docs.groupBy("source").agg(F.array_join(line, "").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(path)
        for batch in batches:
            for source, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content:
                    folder.put(f"{source}.jsonl", content.encode())
                else:
                    folder.drop(f"{source}.jsonl")
            yield batch

    rows.mapInArrow(run, "source string, content string").agg(F.count("*")).collect()


@query("""WITH d AS (SELECT source, doc_id, doc_id % 3 AS k, replace(source, 'src', '')::INTEGER % 2 = 0 AS goes FROM documents),
    s AS (SELECT source, any_value(goes) AS goes, count(*) FILTER (k = 0) AS n0, sum(doc_id) FILTER (k = 0) AS t0, count(*) FILTER (k < 2) AS n1, sum(doc_id) FILTER (k < 2) AS t1, count(*) FILTER (k = 2) AS n2, sum(doc_id) FILTER (k = 2) AS t2 FROM d GROUP BY source)
    SELECT 1 AS look, source, 'added' AS change, n0 AS n_records, t0::BIGINT AS total FROM s WHERE n0 > 0
    UNION ALL SELECT 2, source, CASE WHEN n0 > 0 THEN 'changed' ELSE 'added' END, n1, t1::BIGINT FROM s WHERE n1 > n0
    UNION ALL SELECT 3, source, CASE WHEN goes OR n2 = 0 THEN 'removed' WHEN n1 > 0 THEN 'changed' ELSE 'added' END, CASE WHEN goes THEN 0 ELSE n2 END, CASE WHEN goes THEN 0 ELSE coalesce(t2, 0) END::BIGINT FROM s WHERE n1 > 0 OR (n2 > 0 AND NOT goes)""")
def file_changes(spark, sf_dir):
    """Logs that are made, appended to, and then rewritten or removed, each time read as a stream of changes."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id")
    home = f"{canonical.shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    logs, out = f"{home}/logs", f"{home}/out"
    records = F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: x != "")
    numbers = F.transform(records, lambda x: F.get_json_object(x, "$.n").cast("bigint"))
    source = F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def look(number: int) -> None:
        stream = changes.changes(spark, logs, f"{home}/state", max_files=1_000_000)
        rows = stream.select(F.lit(number).alias("look"), source.alias("source"), "change", F.size(numbers).cast("bigint").alias("n_records"), total.alias("total"), F.col("content").isNull().alias("gone"))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{home}/cp").trigger(availableNow=True).start().awaitTermination()

    try:
        k = F.col("doc_id") % 3
        _write_logs(d.where(k == 0), logs)
        look(1)
        _write_logs(d.where(k < 2), logs)
        look(2)
        stays = F.pmod(F.regexp_replace("source", "src", "").cast("int"), F.lit(2)) == 1
        # a source without records has an empty log, which is removed
        _write_logs(d.where((k == 2) & stays).unionByName(d.select("source", F.lit(None).cast("bigint").alias("doc_id"))), logs)
        look(3)
        found = spark.read.parquet(out)
        return canonical.checkpoint(found.select("look", "source", "change", *[F.when(F.col("gone"), 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("n_records", "total")]))
    finally:
        canonical.remove_folder(spark, home)
