"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest object, in bytes, that an operator of this package hands to every executor.
BROADCAST_LIMIT = 32 << 20

#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 512

#: Bytes or code points of a text that are split into words at a time, about.
PIECE = 1 << 16
_BLANK = re.compile(rb"[ \t\n\v\f\r]")

#: ASCII lower-casing for UTF-8 bytes.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder of the cluster.

    ``spark.checkpoint.dir`` is honoured where the session has it.  Without one a session
    in a single process (a local test) gets a folder of its own; a cluster is refused, as
    its executors would write to their own disks.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def fresh(name: str, *taken: DataFrame) -> str:
    """A column name that no given table has, in any case."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the input tables; a missing column reads as null."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column | str) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.col(text) if isinstance(text, str) else text, upper, upper.lower())


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded rows; an empty batch has none."""
    return (batch.slice(i, SLICE_ROWS) for i in range(0, batch.num_rows, SLICE_ROWS))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: ``make`` runs once a task, its result once a slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from map(step, slices(batch))

    return df.mapInArrow(run, schema)


def without(df: DataFrame, key: Column, removed: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in the one column of ``removed``.

    The removed keys are broadcast when their number is proven small, else joined.
    """
    name = fresh("gone", df)
    gone = checkpoint(removed.toDF(name).distinct())
    small = gone.count() * 128 <= BROADCAST_LIMIT  # hashes, digests and ids take less than 128 bytes each
    return df.join(F.broadcast(gone) if small else gone, key.eqNullSafe(F.col(name)), "left_anti")


def pieces(pattern, text: str) -> Iterator[list[str]]:
    """All matches of a pattern in a text, in lists of bounded length."""
    if len(text) <= PIECE:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while part := [m[0] for m in islice(found, PIECE)]:
        yield part


def blank_pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text between its white space (as ``bytes.split`` has it), in lists of bounded length."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            gap = _BLANK.search(text, at + PIECE)
            end = gap.start() if gap else end
        yield text[at:end].split()
        at = end


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null reads as the empty text."""
    return [x or "" for x in column.to_pylist()]


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, without decoding it; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
