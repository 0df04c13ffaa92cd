"""Sketches of parts against the sorted whole; what leaves of a running query."""

import time

import numpy as np
from pyspark.sql import functions as F

from loomtrace.streaming import metrics


def test_merged_halves_are_within_bound(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.exponential(1, 30_000), rng.exponential(50, 3_000), np.full(7_000, 4.0)])
    rng.shuffle(values)
    frame = spark.createDataFrame([("load" if k % 3 else "send", "ok", float(v), k % 7) for k, v in enumerate(values)], "stage string, outcome string, seconds double, part int")
    frame = frame.unionByName(spark.createDataFrame([("load", "ok", None, 0), ("load", "ok", float("nan"), 0)], frame.schema))
    parts = [metrics.sketches(frame.where(f"part = {k}")) for k in range(7)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    for r in metrics.percentiles(metrics.merged(every), 0.5, 0.95, 0.99).collect():
        whole = np.sort([v for k, v in enumerate(values) if ("load" if k % 3 else "send") == r.stage])
        assert (r.n, r.longest) == (len(whole), whole[-1])
        for share, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            low, high = np.searchsorted(whole, got, "left") / len(whole), np.searchsorted(whole, got, "right") / len(whole)
            assert low - 0.02 <= share <= high + 0.02
    assert metrics.merged(every, "outcome").first().n == len(values)
    assert metrics.percentiles(metrics.merged(every.limit(0)), 0.5).count() == 0


def test_batches_are_stored_and_observed(spark, tmp_path):
    spans = spark.createDataFrame([("load", "ok" if k % 4 else "error", float(k)) for k in range(100)], "stage string, outcome string, seconds double")
    spans.write.parquet(str(tmp_path / "in"))
    sent = []
    exporter = metrics.Exporter(spark, lambda *a: sent.append(a), {"source": "pi", "note": "free text", "phase": "not a word!"})
    spark.streams.addListener(exporter)
    try:
        stream = metrics.observed(spark.readStream.schema(spans.schema).parquet(str(tmp_path / "in")), "spans", F.col("outcome") == "error", F.col("seconds"))
        write = metrics.sketch_writer(str(tmp_path / "out"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        write(spans, 0)  # the same batch again
        for _ in range(40):
            if any(n.endswith("query.ended") for n, *_ in sent):
                break
            time.sleep(0.25)
    finally:
        spark.streams.removeListener(exporter)
    assert {r.outcome: r.n for r in metrics.merged(metrics.stored(spark, str(tmp_path / "out"))).collect()} == {"ok": 75, "error": 25}
    figures = {n: v for n, v, _ in sent}
    assert figures["loomtrace.observed.failed"] == 25 and figures["loomtrace.observed.longest"] == 99 and figures["loomtrace.observed.rows"] == 100
    assert all(set(a) <= {"source", "outcome"} for *_, a in sent) and sent[0][2] == {"source": "pi"}
