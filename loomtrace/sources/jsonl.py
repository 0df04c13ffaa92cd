"""Tail-safe JSON lines: a line counts once it is terminated."""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FACT

MAX_LINE_BYTES = 256 << 20
SAMPLE = 64 << 10


def files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """``path``, ``modificationTime``, ``length``, ``content`` of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def sample_hash(content):
    """SHA-256 of the first and last 64 KiB and the decimal size."""
    n = F.length(content)
    tail = F.when(n > SAMPLE, F.substring(content, n - F.least(n, F.lit(SAMPLE)) + 1, F.lit(SAMPLE))).otherwise(content)
    return F.sha2(F.concat(F.substring(content, 1, SAMPLE), tail, F.encode(n.cast("string"), "UTF-8")), 256)


def lines(found: DataFrame) -> DataFrame:
    """``path``, ``line_no`` (physical, from 1), ``record_no`` (parsed records, from 1), ``line``.

    Text after the last line feed is an unfinished line and left out even if it parses,
    or ends within a character (bytes are not decoded before they are cut);
    one trailing carriage return goes; blank lines count but give no row.
    """
    parts = found.select("path", F.split(F.col("content").cast("string"), "\n").alias("parts"))
    each = parts.select("path", F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("i", "raw")).select("path", (F.col("i") + 1).alias("line_no"), F.regexp_replace("raw", r"\r\z", "").alias("line"))
    rows = each.where(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    return rows.withColumn("record_no", F.row_number().over(Window.partitionBy("path").orderBy("line_no")))


def records(found: DataFrame) -> DataFrame:
    """Lines with their ``value`` (variant) and ``malformed``: does any terminated line of the file not parse?"""
    parsed = lines(found).withColumn("value", F.try_parse_json("line"))
    bad = F.bool_or(F.col("value").isNull()).over(Window.partitionBy("path"))
    return parsed.withColumn("malformed", bad)


def first_line(content):
    """First terminated line of a file that is not blank, without reading on; null without one."""
    return F.nullif(F.regexp_extract(content.cast("string"), r"\A\s*+(\S[^\n]*+)\n", 1), F.lit(""))


def header(found: DataFrame) -> DataFrame:
    """``path``, ``line``, ``value`` (variant) and ``malformed`` of the first record of every file that has one."""
    rows = found.select("path", F.regexp_replace(first_line(F.col("content")), r"\r\z", "").alias("line")).where("line is not null")
    return rows.withColumn("value", F.try_parse_json("line")).withColumn("malformed", F.col("value").isNull())


class Line(NamedTuple):
    number: int
    record: int
    value: object


def read_lines(content: bytes) -> list[Line]:
    """The same for one file's bytes; a malformed or over-long line is an error."""
    out, n = [], 0
    for number, raw in enumerate(content.split(b"\n")[:-1], 1):
        raw = raw.removesuffix(b"\r")
        if len(raw) > MAX_LINE_BYTES:
            raise ValueError(f"line {number} exceeds {MAX_LINE_BYTES} bytes")
        if raw.strip():
            try:
                n += 1
                out.append(Line(number, n, json.loads(raw)))
            except ValueError as e:
                raise ValueError(f"malformed JSON in line {number}") from e
    return out


def read_sample_hash(content: bytes) -> str:
    return hashlib.sha256(content[:SAMPLE] + content[-SAMPLE:] + str(len(content)).encode()).hexdigest()


def with_label(sample: str, label: str | None) -> str:
    """A fingerprint that a label takes part in."""
    return hashlib.sha256(f"{sample}\nlabel:{label}".encode()).hexdigest() if label else sample


def label_folded(sample, label):
    """The same as Columns."""
    return F.when(label.isNotNull() & (label != ""), F.sha2(F.concat(sample, F.lit("\nlabel:"), label), 256)).otherwise(sample)


#: Bytes of a file of reviewed facts, at most.
FACT_BYTES = 64 << 10


def reviewed_facts(spark: SparkSession, path: str) -> DataFrame:
    """``pos`` and the columns of ``schemas.FACT`` from a JSON array; no file gives no facts.

    More than 64 KiB, no array, or a fact without its parts is an error.
    """
    fact = ", ".join(f.replace(" ", ":", 1) for f in FACT.split(", "))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"pos int, {FACT}")
    text = F.decode("content", "UTF-8")
    kind = F.schema_of_variant(F.try_parse_json(text))
    fail = lambda message: F.raise_error(F.lit(message)).cast(f"array<struct<{fact}>>")
    small = F.when(F.col("length") > FACT_BYTES, fail("reviewed facts exceed 64 KiB")).when(~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), fail("reviewed facts must be an array")).otherwise(F.from_json(text, f"array<struct<{fact}>>"))
    return spark.read.format("binaryFile").load(path).select(F.posexplode(small).alias("pos", "f")).select("pos", "f.*")
