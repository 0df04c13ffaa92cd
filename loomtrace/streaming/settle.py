"""Settle and change detection over a stream of observations."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.canonical import create_new
from ..sources.files import Folder

PAUSE = "paused"
OUT = "source string, native_session_id string, fingerprint string, observed_at timestamp, settled boolean"


def settled(observations: DataFrame, seconds: int) -> DataFrame:
    """Each observation ``(source, native_session_id, fingerprint, observed_at)`` with ``settled``.

    State of a session: its fingerprint and when that was first seen.  Nothing expires
    by watermark: a session may change at any time, and a late look never drops it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else (None, None)
        for frame in frames:
            frame = frame.sort_values("observed_at", kind="stable")
            at, look = frame["observed_at"].astype("datetime64[us]").astype("int64"), frame["fingerprint"].fillna("\0")
            fresh = look != look.shift()
            fresh.iloc[0] = known[1] is None or look.iloc[0] != known[0]
            since = at.where(fresh).ffill().fillna(known[1] or 0).astype("int64")
            yield pd.DataFrame({"source": key[0], "native_session_id": key[1], "fingerprint": frame["fingerprint"].values, "observed_at": frame["observed_at"].values, "settled": (~fresh & (at - since >= seconds * 1_000_000)).values})
            known = (look.iloc[-1], int(since.iloc[-1]))
        state.update(known)

    return observations.groupBy("source", "native_session_id").applyInPandasWithState(step, OUT, "fingerprint string, first_seen bigint", "append", GroupStateTimeout.NoTimeout)


def heartbeat_windows(heartbeats: DataFrame, at: str = "ts", every: str = "2 minutes", late: str = "3 minutes") -> DataFrame:
    """``window_start``, ``n``: heartbeats of each tumbling window, also of those without any, for an alert on them.

    A second stream of clock ticks (``rate``) opens every window, so a window closes with
    zero even if nothing was heard.  Over a table the windows between the first and the
    last heartbeat are shown.
    """
    if heartbeats.isStreaming:
        ticks = heartbeats.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        heard = heartbeats.select(F.col(at).alias("at"), F.lit(1).alias("n")).unionByName(ticks.select(F.col("timestamp").alias("at"), F.lit(0).alias("n")))
        return heard.withWatermark("at", late).groupBy(F.window("at", every).alias("w")).agg(F.sum("n").alias("n")).select(F.col("w.start").alias("window_start"), "n")
    start = F.window(at, every)["start"]
    got = heartbeats.where(F.col(at).isNotNull()).groupBy(start.alias("window_start")).agg(F.count("*").alias("n"))
    spine = got.agg(F.min("window_start").alias("a"), F.max("window_start").alias("z")).select(F.explode(F.sequence("a", "z", F.expr(f"interval {every}"))).alias("window_start"))
    return spine.join(got, "window_start", "left").select("window_start", F.coalesce("n", F.lit(0)).alias("n"))


def outbox_writer(path: str, order: str | None = None):
    """A ``foreachBatch`` writer with one effect an operation, in whatever batches it comes and however often one is repeated.

    A batch replaces its own folder, and leaves out operations that an earlier batch has
    written.  Of repeated operations in a batch the first by ``order`` stays (the
    smallest row where none is given), so a batch that is run again writes the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != "operation_id"]
        by = F.struct(*[F.col(c) for c in ([order] if order else []) + [c for c in rest if c != order]]) if rest else None
        first = batch.select("operation_id").distinct() if by is None else batch.groupBy("operation_id").agg(F.min(by).alias("r")).select(*[F.col("r")[c].alias(c) if c in rest else F.col(c) for c in batch.columns])
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            earlier = spark.read.schema(f"operation_id {batch.schema['operation_id'].dataType.simpleString()}, batch bigint").option("recursiveFileLookup", False).parquet(path).where(F.col("batch") < batch_id)
            first = first.join(earlier.select("operation_id").distinct(), "operation_id", "left_anti").select(batch.columns)
        first.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def paused(folder: str) -> bool:
    """Is the pause marker set?"""
    return Folder(folder).get(PAUSE) is not None


def set_paused(folder: str, value: bool) -> None:
    if value:
        Folder(folder).put(PAUSE, b"paused\n")
    else:
        Folder(folder).drop(PAUSE)


class Fenced(RuntimeError):
    """Another writer has taken the folder over."""


class Writer:
    """The right to change the state in a folder, for all sessions that share it.

    The folder has a log of numbered files, each made by one writer only.  A new writer
    opens by taking the next number; one that it displaces finds that number taken when
    it next commits, and is refused, wherever it runs and however long it has slept.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log, self.me = spark, f"{folder}/log", uuid.uuid4().hex
        self.files = Folder(self.log)
        while not self._append(len(self.files.names("", ".json")) + 1, {"kind": "open"}):
            pass  # another one opens as well: the last one stays

    def _append(self, number: int, entry: dict) -> bool:
        self.number = number
        return create_new(self.spark, f"{self.log}/{number:012d}.json", json.dumps(entry | {"writer": self.me}))

    def check(self) -> None:
        """Refuse if another writer has come since."""
        if self.files.get(f"{self.number + 1:012d}.json") is not None:
            raise Fenced(f"another writer holds {self.log}")

    def commit(self, **entry) -> None:
        """Record what has been done, or refuse, in one step."""
        if not self._append(self.number + 1, {"kind": "commit"} | entry):
            raise Fenced(f"another writer holds {self.log}")

    def done(self, batch_id: int) -> bool:
        """Has a batch been committed, by whomever?"""
        found = (json.loads(self.files.get(n)) for n in reversed(self.files.names("", ".json")))
        last = next((e for e in found if "batch" in e), None)
        return last is not None and last["batch"] >= batch_id


def run_loop(stream: DataFrame, folder: str, checkpoint: str, step: Callable[[DataFrame, int], None], seconds: int | None = 900, poll: float = 1.0):
    """A scan or drain as a query: ``step`` a batch, every so many seconds (None: once over what is there).

    While the pause marker is set a batch waits before it does anything, and goes on
    without a restart.  One writer holds the folder: the loop that was started last; an
    older one fails at its next batch, at the latest when it commits.  A batch that was
    committed is not done again.  Batches are bounded by the options of the source (files
    or rows a trigger).
    """
    writer = Writer(stream.sparkSession, folder)

    def guarded(batch: DataFrame, batch_id: int) -> None:
        while paused(folder):
            time.sleep(poll)
        writer.check()
        if not writer.done(batch_id):
            step(batch, batch_id)
            writer.commit(batch=batch_id)

    out = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds} seconds")).start()
