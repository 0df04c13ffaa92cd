"""SimHash near-duplicates through per-segment bit counts.

A fingerprint's 64 bits form 32 segments of two; its embedding is the vector of their
bit counts.  The Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints, so pairs within ``LINK_BITS`` bits lie within that
Manhattan distance.  The 32 axes are cut into ``BLOCKS`` groups: a pair within distance
2 differs in at most two of them, so it shares a grid cell over some three whole groups.
Cells are joined on themselves, the Manhattan bound goes first, the exact test last.

Counts are held in unary (one bit for "at least one", one for "two"), so that the
Manhattan distance of two embeddings is the number of bits in which they differ.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, blank_pieces, blobs, checkpoint, map_batches, without
from .graph import components

SHINGLE, LINK_BITS, BLOCKS = 3, 2, 5
#: Members of a cell up to which its pairs are tested; larger cells are linked through midpoints.
PAIRED_CELL = 64
_EVEN = 0x5555555555555555


def fingerprint(text: bytes) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    for more in blank_pieces(text.translate(ASCII_LOWER)):
        words = words[-(SHINGLE - 1) :] + more if n else words + more
        if len(words) < SHINGLE:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = map(joined.__getitem__, map(slice, starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    if not n:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).astype(np.int64)) if words else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (bigint) of every row; null and wordless texts have fingerprint 0."""

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in blobs(batch.column(1))], pa.int64())], [id_col, "fp"])

    return map_batches(df.select(id_col, text_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp bigint")


def embedding(fp: Column) -> Column:
    """Two-bit segment counts in unary, one segment to two bits."""
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(F.lit(_EVEN)), fp.bitwiseAND(high).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _masks() -> list[int]:
    """For each choice of groups to match, the bits of their axes, as signed integers."""
    groups = [0] * BLOCKS
    for axis in range(32):
        groups[axis * BLOCKS // 32] |= 3 << (2 * axis)
    masks = [sum(c) for c in combinations(groups, BLOCKS - LINK_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between distinct ``fp`` values whose components are those of all links.

    Cells with up to ``PAIRED_CELL`` members give all their pairs within ``LINK_BITS``
    bits.  Larger cells depart from the grid join, which would give all pairs of a cell:
    their members go through midpoints, without the Manhattan bound.  Two fingerprints
    differ in at most two bits exactly if some point is within one bit of both, so all
    that share a point are linked to the smallest of them.  That is exact as well (the
    components are the same for any ``PAIRED_CELL``) and grows with the members, not
    with their pairs.  Null fingerprints are not expected; none give no edges.
    """
    cells = [F.struct(F.lit(k).alias("k"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(_masks())]
    points = fps.select("fp", embedding(F.col("fp")).alias("e")).select("fp", "e", F.explode(F.array(*cells)).alias("c")).select("fp", "e", "c.k", "c.cell")
    sizes = points.groupBy("k", "cell").agg(F.count("*").alias("size")).where("size > 1")
    shared = checkpoint(points.join(sizes, ["k", "cell"]))
    small = shared.where(F.col("size") <= PAIRED_CELL)
    a, b = small.alias("a"), small.alias("b")
    pair = (
        (F.col("a.k") == F.col("b.k"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.e").bitwiseXOR(F.col("b.e"))) <= LINK_BITS)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= LINK_BITS)
    )
    pairs = a.join(b, pair).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    hot = shared.where(F.col("size") > PAIRED_CELL).select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)]
    around = hot.select("fp", F.explode(F.array(*near)).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("mid", "a")
    stars = around.join(least, "mid").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (smallest id reachable over links) of every row.

    Null and wordless texts have fingerprint 0 and link like any other; a null id takes
    part but never names a component (one of null ids alone has a null name); repeated
    rows stay; an empty table gives an empty result; only the two named columns are
    read.  Fingerprints are computed once and kept as 16 bytes a row; links are sought
    between distinct fingerprints only, and names go back to rows by fingerprint.
    """
    rows = checkpoint(fingerprints(df, id_col, text_col))
    groups = checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    member = components(links(groups.select("fp"))).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = groups.join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(id_col, "fp", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each component: the smallest id, then a hash of its text.

    Null ids come last, so a group of null ids keeps one of its texts; rows that repeat
    the one that stays, id and text, stay with it.
    """
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    found = near_duplicates(df.select(row.alias("_row"), text_col), "_row", text_col)
    return without(df, row, found.where("_row <> component_id").select("_row"))
