"""Timers of quiet keys: a session that settles, a host that falls silent, with no further row to notice it.

State lives in Spark's keyed state with processing-time timers, so a restart finds both.
The session must use the RocksDB state store (:func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SETTLED = "source string, native_session_id string, fingerprint string, observed_at timestamp, settled boolean, by_timer boolean"
SILENT = "host string, last_heard timestamp, silent boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Set the state store that timers need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _reset(handle: StatefulProcessorHandle, at: int | None) -> None:
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(at)


class _Settle(StatefulProcessor):
    """State of a session: its fingerprint, when that was first seen, and whether its settling was told."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "fingerprint string, first_seen bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("observed_at", kind="stable")  # the looks at one session in one batch
        mark, since, told = self.known.get() if self.known.exists() else (None, None, False)
        out = []
        for look, at in zip(frame["fingerprint"], frame["observed_at"], strict=True):
            millis = int(at.value // 1_000_000)
            look = None if pd.isna(look) else look
            if since is None or look != mark:
                mark, since, told = look, millis, False
            settled = millis - since >= self.millis
            told = told or settled
            out.append((*key, look, at, settled, False))
        self.known.update((mark, since, told))
        # the clock of the timer is that of this process, and never earlier than the looks say
        _reset(self.handle, None if told else max(since, timerValues.getCurrentProcessingTimeInMs()) + self.millis)
        yield _frame(out, SETTLED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, since, told = self.known.get()
        if not told:
            self.known.update((mark, since, True))
            yield _frame([(*key, mark, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), True, True)], SETTLED)

    def close(self) -> None:
        pass


class _Silence(StatefulProcessor):
    """State of a host: when it was last heard, and whether its silence was told."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "heard bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        heard = max(int(frame["at"].max().value // 1_000_000) for frame in rows)
        before, told = self.last.get() if self.last.exists() else (heard, False)
        self.last.update((max(heard, before), False))
        _reset(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.millis)
        if told:
            yield _frame([(*key, pd.Timestamp(heard, unit="ms"), False)], SILENT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        heard, _ = self.last.get()
        self.last.update((heard, True))
        yield _frame([(*key, pd.Timestamp(heard, unit="ms"), True)], SILENT)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def settled(observations: DataFrame, seconds: int) -> DataFrame:
    """Each observation ``(source, native_session_id, fingerprint, observed_at)`` with ``settled``, and a row when a quiet session settles.

    A look settles a session whose fingerprint has stood still for so many seconds.  A
    session that nobody looks at again settles as many seconds after its last change was
    taken in, by a timer (``by_timer``), once.  A null fingerprint is one like any other.
    """
    given = observations.select("source", "native_session_id", "fingerprint", "observed_at")
    return given.groupBy("source", "native_session_id").transformWithStateInPandas(_Settle(seconds), SETTLED, "append", "processingTime")


def silences(heartbeats: DataFrame, host: str = "host", at: str = "ts", seconds: int = 180) -> DataFrame:
    """``host``, ``last_heard``, ``silent``: a row when a host has not been heard for so many seconds, and one when it is heard again."""
    given = heartbeats.where(f"{at} is not null").selectExpr(f"{host} as host", f"{at} as at")
    return given.groupBy("host").transformWithStateInPandas(_Silence(seconds), SILENT, "append", "processingTime")
