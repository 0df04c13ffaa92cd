"""Comparison of two keyed tables through stored hash trees: what agrees is not read.

A key lies at the leaf that the first ``DEPTH`` hex digits of its hash name; a node is a
prefix of them.  A leaf's digest is over its keys and hashes, an inner node's over its
children.  Trees are stored beside the rows, which are sorted by leaf, when a table is
written; a comparison reads a level of both trees only below nodes that differ, and rows
only of leaves that differ.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .canonical import checkpoint

#: Digits of a leaf, at most, rows of a leaf, about, and prefixes that are handed to a scan as literals.
DEPTH, LEAF_ROWS, LITERALS = 12, 64, 10_000


class Tree(NamedTuple):
    """A stored table with its tree."""

    spark: SparkSession
    path: str
    key: str
    depth: int

    def level(self, n: int) -> DataFrame:
        return self.spark.read.schema("node string, digest string, n bigint").parquet(f"{self.path}/level={n}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")


class Differences(NamedTuple):
    """Keys whose rows differ, with both hashes; how many nodes and rows were read for them, and how many rows there are."""

    rows: DataFrame
    nodes_read: int
    rows_read: int
    rows_all: int


def depth_for(rows: int) -> int:
    """Digits of a leaf so that leaves have about ``LEAF_ROWS`` rows; both trees of a comparison need the same."""
    return min(DEPTH, max(1, math.ceil(math.log(max(rows, 1) / LEAF_ROWS, 16)))) if rows > LEAF_ROWS else 1


def _leaf(key: str) -> Column:
    return F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("\0")), 256), 1, DEPTH)


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256)


def write(rows: DataFrame, key: str, hash_: str, path: str, depth: int, extra: list[str] | None = None) -> Tree:
    """Store ``key``, ``hash_`` and ``extra`` columns, sorted by leaf, and the levels of their tree.

    Rows of a leaf are few by the choice of ``depth``, whatever the keys; each level is
    made from the one below.  A repeated key counts as often as it comes.
    """
    spark = rows.sparkSession
    kept = rows.select(F.substring(_leaf(key), 1, depth).alias("leaf"), key, F.col(hash_).alias("hash"), *(extra or []))
    kept.repartitionByRange("leaf").sortWithinPartitions("leaf").write.mode("overwrite").parquet(f"{path}/rows")
    # lengths keep a key and its hash apart; a null hash has none
    line = F.concat_ws(":", F.length(F.coalesce(F.col(key).cast("string"), F.lit("\0"))).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.when(F.col("hash").isNull(), "n").otherwise("v"), F.coalesce("hash", F.lit("")))
    if extra:
        line = F.concat_ws("|", line, F.to_json(F.struct(*extra), {"ignoreNullFields": "false"}))
    nodes = spark.read.parquet(f"{path}/rows").groupBy(F.col("leaf").alias("node")).agg(_digest(line).alias("digest"), F.count("*").alias("n"))
    for n in range(depth, 0, -1):
        nodes.repartitionByRange("node").sortWithinPartitions("node").write.mode("overwrite").parquet(f"{path}/level={n}")
        nodes = spark.read.parquet(f"{path}/level={n}").groupBy(F.substring("node", 1, n - 1).alias("node")).agg(_digest(F.concat("node", "digest")).alias("digest"), F.sum("n").alias("n"))
    return Tree(spark, path, key, depth)


def _below(table: DataFrame, column: str, length: int, nodes: DataFrame, found: list[str] | None) -> DataFrame:
    """Rows under some nodes: by ranges that reach the scan while they are few, else by a join."""
    if found is None:
        return table.join(nodes.withColumnRenamed("node", "_node"), F.substring(column, 1, length) == F.col("_node"), "left_semi")
    if not found:
        return table.limit(0)
    test = F.substring(column, 1, length).isin(found) if length else F.lit(True)
    return table.where(test & F.col(column).between(min(found), max(found) + "g"))  # g is after all digits


def compare(left: Tree, right: Tree) -> Differences:
    """Keys that only one table has, or with another hash: ``key``, ``left`` and ``right`` rows (hash and extra columns, null where missing).

    The trees must have the same depth.  Keys that agree are not listed; those of a leaf
    that differs are read and left out.  A repeated key has a row each time it differs.
    """
    if left.depth != right.depth:
        raise ValueError("trees of another depth")
    spark, nodes_read = left.spark, 0
    differing = spark.createDataFrame([("",)], "node string")
    names: list[str] | None = [""]
    for n in range(1, left.depth + 1):
        a, b = (_below(t.level(n), "node", n - 1, differing, names).select("node", F.col("digest").alias(s), F.col("n").alias(f"n{s}")) for t, s in ((left, "a"), (right, "b")))
        both = checkpoint(a.join(b, "node", "full_outer"))
        nodes_read += both.count()
        differing = checkpoint(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node"))
        few = differing.limit(LITERALS + 1).collect()
        names = sorted(r.node for r in few) if len(few) <= LITERALS else None
    a, b = (checkpoint(_below(t.rows(), "leaf", left.depth, differing, names)) for t in (left, right))
    side = lambda t: t.select(F.col(left.key).alias("_key"), F.struct(*[c for c in t.columns if c not in ("leaf", left.key)]).alias("_row")).withColumn("_said", F.to_json("_row"))
    # rows that agree leave in pairs; what is left of a repeated key is paired in order
    nth = lambda t, *by: t.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("_said")))
    a_rows, b_rows = (nth(side(t), "_key", "_said") for t in (a, b))
    same = lambda t, u: F.col(f"{t}._key").eqNullSafe(F.col(f"{u}._key")) & (F.col(f"{t}._nth") == F.col(f"{u}._nth"))
    alone = lambda t, u: nth(t.alias("t").join(u.alias("u"), same("t", "u") & (F.col("t._said") == F.col("u._said")), "left_anti").drop("_nth"), "_key")
    changed = alone(a_rows, b_rows).alias("l").join(alone(b_rows, a_rows).alias("r"), same("l", "r"), "full_outer")
    total = left.level(1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + right.level(1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Differences(changed.select(F.coalesce("l._key", "r._key").alias(left.key), F.col("l._row").alias("left"), F.col("r._row").alias("right")), nodes_read, a.count() + b.count(), total)
