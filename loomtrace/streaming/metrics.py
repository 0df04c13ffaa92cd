"""Durations as mergeable sketches, and what a running query observes, exported through the allow-lists.

A batch stores a sketch for each stage and outcome; sketches of any batches merge, so
percentiles of a day, a week or one stage need no look at the spans again.  Ranks of
estimates are off by a bounded share (about 0.7 % at the size used here, whatever the data).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import telemetry

#: Size of a sketch: its error falls with it.
SIZE = 400
SKETCH = "stage string, outcome string, n bigint, longest double, sketch binary"


def sketches(spans: DataFrame, stage: str = "stage", outcome: str = "outcome", seconds: str = "seconds") -> DataFrame:
    """``stage``, ``outcome``, ``n``, ``longest``, ``sketch``; durations that are null or no numbers count nowhere."""
    held = spans.select(F.col(stage).alias("stage"), F.col(outcome).alias("outcome"), F.col(seconds).cast("double").alias("s")).where("s is not null and not isnan(s)")
    return held.groupBy("stage", "outcome").agg(F.count("*").alias("n"), F.max("s").alias("longest"), F.kll_sketch_agg_double("s", SIZE).alias("sketch"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches of batches as one for each stage and outcome, or for other columns."""
    keys = by or ("stage", "outcome")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("longest").alias("longest"), F.kll_merge_agg_double("sketch", SIZE).alias("sketch"))


def percentiles(found: DataFrame, *shares: float) -> DataFrame:
    """Sketches with a column for each share, ``p50`` for 0.5."""
    names = [(s, f"p{s * 100:g}".replace(".", "_")) for s in shares]
    return found.select(*[c for c in found.columns if c != "sketch"], *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(n) for s, n in names])


def sketch_writer(path: str, stage: str = "stage", outcome: str = "outcome", seconds: str = "seconds") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of sketches; a batch that is run again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sketches(batch, stage, outcome, seconds).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Sketches of all batches."""
    return spark.read.schema(f"{SKETCH}, batch bigint").parquet(path)


def observed(df: DataFrame, name: str, failed: Column, seconds: Column) -> DataFrame:
    """The table as it is, with figures that a listener gets with each batch: rows, failures, the longest duration."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failed"), F.max(seconds).alias("longest"))


class Exporter(StreamingQueryListener):
    """Hands figures of every batch to ``send(name, value, attributes)``: only of known names, with allowed attributes.

    ``attributes`` are the same for all figures (such as ``source`` or ``phase``); those
    that the allow-lists do not know, or whose value looks like free text, never leave.
    """

    FIGURES = ("rows", "failed", "longest")

    def __init__(self, spark: SparkSession, send: Callable[[str, float, dict], None], attributes: dict[str, str] | None = None, prefix: str = "loomtrace"):
        self.send, self.prefix = send, prefix
        given = F.from_json(F.lit(json.dumps(attributes or {})), "map<string,string>")
        self.attributes = dict(spark.range(1).select(telemetry.safe_metric_attributes(given).alias("a")).first().a or {})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.send(f"{self.prefix}.query.started", 1.0, self.attributes)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.send(f"{self.prefix}.batch.rows", float(p.numInputRows), self.attributes)
        for row in p.observedMetrics.values():
            for figure, value in row.asDict().items():
                if figure in self.FIGURES and isinstance(value, int | float) and math.isfinite(value):
                    self.send(f"{self.prefix}.observed.{figure}", float(value), self.attributes)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.send(f"{self.prefix}.query.ended", 1.0, self.attributes | {"outcome": "error" if event.exception else "ok"})
