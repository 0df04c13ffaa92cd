"""Timers fire with no further row, once, also over a restart."""

import datetime as dt
import time

import pytest

from loomtrace.streaming import timers


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    timers.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def watch(df, place, out, until, seconds=40):
    """Run a query until its rows satisfy ``until``."""
    spark = df.sparkSession
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(processingTime="500 milliseconds").start()
    rows, end = [], time.time() + seconds
    try:
        while time.time() < end:
            if query.exception():
                raise query.exception()
            try:
                rows = spark.read.schema(df.schema).parquet(out).collect()
            except Exception:  # nothing is written yet
                rows = []
            if until(rows):
                break
            time.sleep(0.5)
    finally:
        query.stop()
    return rows


def test_a_quiet_session_settles(rocks, tmp_path):
    spark, now = rocks, dt.datetime.now(dt.UTC).replace(tzinfo=None)
    schema = "source string, native_session_id string, fingerprint string, observed_at timestamp"
    source, place, out = str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "out")
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    put(("pi", "a", "x", now), ("pi", "old", "x", now - dt.timedelta(hours=1)), ("pi", "old", "x", now))
    stream = lambda: timers.settled(spark.readStream.schema(schema).parquet(source), 6)
    first = watch(stream(), place, out, lambda rows: len(rows) >= 3)
    assert {(r.native_session_id, r.settled) for r in first if not r.by_timer} == {("a", False), ("old", False), ("old", True)}
    # the query is down for a while; its state and timer are not
    got = watch(stream(), place, out, lambda rows: any(r.by_timer for r in rows))
    assert [(r.native_session_id, r.fingerprint, r.settled) for r in got if r.by_timer] == [("a", "x", True)]
    put(("pi", "a", "y", now + dt.timedelta(seconds=1)))
    got = watch(stream(), place, out, lambda rows: sum(r.by_timer for r in rows) == 2)
    assert sorted((r.native_session_id, r.fingerprint) for r in got if r.by_timer) == [("a", "x"), ("a", "y")]


def test_a_silent_host_is_told(rocks, tmp_path):
    spark, now = rocks, dt.datetime.now(dt.UTC).replace(tzinfo=None)
    source, place, out = str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "out")
    put = lambda *hosts: spark.createDataFrame([(h, now) for h in hosts], "host string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    put("a", "b", "b")
    stream = lambda: timers.silences(spark.readStream.schema("host string, ts timestamp").parquet(source), seconds=2)
    got = watch(stream(), place, out, lambda rows: len(rows) == 2)
    assert sorted((r.host, r.silent) for r in got) == [("a", True), ("b", True)]
    put("b")
    got = watch(stream(), place, out, lambda rows: len(rows) == 4)
    assert sorted((r.host, r.silent) for r in got) == [("a", True), ("b", False), ("b", True), ("b", True)]
