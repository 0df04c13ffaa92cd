"""Canonical documents from turns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

MAX_BYTES = 100 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for files between jobs: the one that ``spark.checkpoint.dir`` names.

    Without that setting a session in one process gets a folder of its own; a cluster is
    refused, as its executors would write to their own disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def create_new(spark: SparkSession, path: str, body: str) -> bool:
    """Make a file that appears whole, unless there is one of its name: of several writers one succeeds."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, aside = hadoop.Path(path), hadoop.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, False)
    out.write(bytearray(body.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(fs.makeQualified(place).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(place), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception:
        fs.delete(aside, False)
        if fs.exists(place):
            return False
        raise
    return True


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of files between jobs, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def clean(role: Column, text: Column) -> Column:
    """Content of a turn: normalized, without harness context (users only) or injected memory."""
    text = C.normalize_text(text)
    return C.strip_injected(F.when(role == "user", C.strip_harness(text)).otherwise(text))


def provenance(session: str, order: str, role: Column, kept: Column, calls_memory: Column) -> Column:
    """Of turns without parents: memory-assisted after a memory call, until a user speaks."""
    event = F.when((role == "user") & kept, F.lit(False)).when((role == "assistant") & calls_memory, F.lit(True))
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    pending = F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False))
    return F.when(role == "assistant", F.when(pending, "memory-assisted").otherwise("original"))


def provenance_tree(turns: DataFrame) -> DataFrame:
    """``session``, ``entry``, ``pending_out`` over parents: ``turns(session, seq, entry, parent, event)``.

    ``event`` sets (true) or clears (false) the memory state, null passes it on; a
    parent must come earlier in its session, otherwise the state begins as false.
    A repeated parent gives a row for each path to it, as in SQL.

    Every round joins each path with the one above its end, so paths double in length
    and rounds grow with the logarithm of the deepest chain, whatever the number of
    turns.  Every round is cut off with a checkpoint.
    """
    rows = checkpoint(turns.select("session", "seq", "entry", "parent", "event").withColumn("id", F.monotonically_increasing_id()))
    known = rows.select(F.col("session").alias("p_session"), F.col("entry").alias("p_entry"), F.col("seq").alias("p_seq"), F.col("id").alias("up"))
    earlier = (F.col("session") == F.col("p_session")) & (F.col("parent") == F.col("p_entry")) & (F.col("p_seq") < F.col("seq"))
    paths = checkpoint(rows.join(known, earlier, "left").select("id", "session", "entry", "up", "event"))
    while paths.where("up is not null").limit(1).count():
        above = paths.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("event").alias("before"))
        further = paths.where("up is not null").join(above, "up").select("id", "session", "entry", F.col("next").alias("up"), F.coalesce("event", "before").alias("event"))
        paths = checkpoint(paths.where("up is null").unionByName(further))
    return paths.select("session", "entry", F.coalesce("event", F.lit(False)).alias("pending_out"))


def sessions(lines: DataFrame, session: str, order: str, line: str = "line", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Bytes, turns, redactions and content hash of each session; one above the limit is refused, never cut.

    The bytes are added up first, and lines of a session above the limit are not
    gathered.  Redactions are the sum of that column, where ``lines`` have one.
    """
    size = F.sum(F.octet_length(line) + 1).over(Window.partitionBy(session))
    sized = lines.withColumn("_size", size).withColumn("_line", F.when(F.col("_size") <= max_bytes, F.struct(order, line)))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x[line]), "\n"), F.lit("\n"))
    redactions = F.sum("redactions") if "redactions" in lines.columns else F.lit(0)
    made = sized.groupBy(session).agg(F.max("_size").alias("canonical_bytes"), F.count("*").alias("canonical_turns"), redactions.cast("bigint").alias("redactions"), F.when(F.max("_size") <= max_bytes, F.sha2(text, 256)).alias("canonical_hash"))
    return made.withColumn("status", F.when(F.col("canonical_bytes") > max_bytes, "too_large").when(F.col("canonical_turns") <= 1, "empty_after_normalization").otherwise("eligible"))


def write_spool(lines: DataFrame, path: str, session: str, order: str, buckets: int = 256, max_bytes: int = MAX_BYTES) -> None:
    """Canonical lines in order as Parquet, by buckets of sessions (a folder a session would be too many files).

    A session above the limit stops the write: a document is never cut.
    """
    size = F.sum(F.octet_length("line") + 1).over(Window.partitionBy(session))
    fits = F.when(size <= max_bytes, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("canonical document exceeds "), F.lit(str(max_bytes)), F.lit(" bytes"))).cast("boolean"))
    kept = lines.withColumn("_fits", fits).where("_fits").drop("_fits").withColumn("bucket", F.pmod(F.xxhash64(session), F.lit(buckets)))
    kept.repartition("bucket").sortWithinPartitions("bucket", session, order).write.partitionBy("bucket").mode("overwrite").parquet(path)


def export(lines: DataFrame, session: str, wanted: object, order: str, artifact: str | None = None) -> DataFrame:
    """Lines of exactly one session, in order.

    None is an error, and so is more than one artifact (files that claim the session), where a column names it.
    """
    found = lines.where(F.col(session) == wanted)
    n = found.select(artifact or session).distinct().limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one artifact of'} session {wanted!r}")
    return found.orderBy(order)
