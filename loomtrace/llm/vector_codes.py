"""Compression of vectors to short codes, with annular norm pruning.

A vector becomes integers and is cut into parts; each part is written as the index of the
nearest entry of its codebook.  An entry can be nearer than a known distance ``r`` only
if its norm lies within ``r`` of the part's own norm, inclusively.  So a codebook is
sorted by norm; the entry of the nearest norm gives the first distance, a binary search
gives the interval of norms that this distance allows, and only the entries of that
annulus are evaluated, exactly.

Codebooks are refined in rounds.  A round is one pass over the vectors, which never move:
tasks send sums and counts of ``PARTS * ENTRIES`` entries, and as many reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BROADCAST_LIMIT, checkpoint, fresh, slices

#: Parts of a vector, entries of a codebook, rounds of refinement, integers a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A label with more than one in so many rows is hot; there are at most as many hot labels.
HOT_LABELS = 100_000
#: Norms beyond this are not compared as floating-point numbers: every entry is evaluated.
LARGEST_NORM = 2.0**1000
LONG = (1 << 63) - 1

Codebooks = list[list[list[int]]]


def part_bounds(size: int, parts: int = PARTS) -> list[int]:
    """Where parts begin and end; a size that does not divide gives the first parts one more component."""
    q, r = divmod(size, parts)
    return [k * q + min(k, r) for k in range(parts + 1)]


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``, exact: int64 where that holds every square sum of a part, else Python integers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    top = np.abs(scaled).max(initial=0)
    if 4 * top * top * max(values.shape[-1], 1) * ENTRIES < 2.0**62:
        return scaled.astype(np.int64)
    exact = [math.floor(Fraction(x) * scale) for x in values.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def _norms(points: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1) if points.shape[1] else np.zeros(len(points), np.int64)
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([float(n) if (n := math.isqrt(int(s))) < LARGEST_NORM else LARGEST_NORM for s in squares], np.float64)


class Codebook:
    """Entries of one part, sorted by norm."""

    def __init__(self, entries: list[list[int]], width: int):
        small = not entries or not width or max(abs(x) for e in entries for x in e) < 1 << 31
        points = np.empty((len(entries), width), np.int64 if small else object)
        for row, entry in enumerate(entries):
            points[row] = entry
        norms = _norms(points)
        self.order = np.argsort(norms, kind="stable")
        self.points, self.norms = points[self.order], norms[self.order]
        self.largest = max((abs(int(x)) for e in entries for x in e), default=0)
        #: (vector, entry) distances evaluated so far, for tests and measurements.
        self.evaluated = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part (ties: the lowest) and its squared distance."""
        n = len(parts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        points, top = self.points, max(int(np.abs(parts).max(initial=0)), self.largest)
        if 4 * top * top * max(parts.shape[1], 1) * len(points) >= 1 << 62:
            parts, points = parts.astype(object), points.astype(object)
        norms = _norms(parts)
        right = np.clip(np.searchsorted(self.norms, norms), 0, len(points) - 1)
        left = np.maximum(right - 1, 0)
        seed = np.where(norms - self.norms[left] < self.norms[right] - norms, left, right)
        radius = np.sqrt(((parts - points[seed]) ** 2).sum(axis=1).astype(np.float64)) if parts.dtype != object else _norms(parts - points[seed])
        # norms and radius may be off by rounding; a little wider is still exact
        slack = 2 + 1e-9 * (norms + radius + self.norms[-1])
        low = np.searchsorted(self.norms, norms - radius - slack, "left")
        high = np.searchsorted(self.norms, norms + radius + slack, "right")
        large = norms >= LARGEST_NORM / 4
        low, high = np.where(large, 0, low), np.where(large, len(points), high)
        counts = high - low
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(n), counts)
        entry = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(low, counts)
        self.evaluated += len(row)
        distance = ((parts[row] - points[entry]) ** 2).sum(axis=1) if parts.shape[1] else np.zeros(len(row), np.int64)
        best = np.minimum.reduceat(distance * len(points) + self.order[entry], ends - counts)
        return (best % len(points)).astype(np.int64), best // len(points)


def kept(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and has neither null nor non-finite components."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a batch have ``size`` components, and those as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    fits = sizes == size
    return fits, flat[np.repeat(fits, sizes)].reshape(int(fits.sum()), size)


def _initial(rows: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> tuple[int, Codebooks]:
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).collect()  # at most ``entries`` rows
    if not first:
        return 0, []
    size = len(first[0][1])
    bounds = part_bounds(size, parts)
    seeds = [[int(x) for x in integers(np.array([v], np.float64).reshape(1, size))[0]] for _, v in first if len(v) == size]
    return size, [[s[a:z] for s in seeds] for a, z in zip(bounds, bounds[1:], strict=False)]


def _refine(vectors: DataFrame, size: int, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; an unused one stays."""
    bounds = part_bounds(size, len(books))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b, z - a) for b, a, z in zip(books, bounds, bounds[1:], strict=False)]
        sums = {}
        for batch in batches:
            for part in slices(batch):
                values = integers(_matrix(part.column(0), size)[1])
                for k, (book, a, z) in enumerate(zip(found, bounds, bounds[1:], strict=False)):
                    index, _ = book.nearest(values[:, a:z])
                    for e in np.unique(index).tolist():
                        mine = values[index == e, a:z]
                        n, total = sums.get((k, e), (0, [0] * (z - a)))
                        sums[k, e] = n + len(mine), [x + int(y) for x, y in zip(total, mine.sum(axis=0), strict=True)]
        yield _totals(sums)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for k, e, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, known = sums.get((k, e), (0, None))
                total = list(map(int, total))
                sums[k, e] = m + n, total if known is None else [x + y for x, y in zip(known, total, strict=True)]
        yield _totals(sums)

    schema = "part int, entry int, n bigint, total array<string>"
    rows = vectors.mapInArrow(totals, schema).repartition("part", "entry").mapInArrow(merged, schema).collect()  # at most one row an entry
    new = [list(b) for b in books]
    for k, e, n, total in rows:
        new[k][e] = [int(x) // n for x in total]
    return new


def _totals(sums: dict) -> pa.RecordBatch:
    keys = list(sums)
    columns = [pa.array([k for k, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([list(map(str, sums[k][1])) for k in keys], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, Codebooks]:
    """Size of a vector and the codebook of each part, from all vectors of ``df``.

    A codebook starts as the parts of the smallest ids (null ids last, vectors of one id
    in their order); fewer vectors give fewer entries, none give none.  The size is that
    of the smallest id's vector; vectors of another size take no part.
    """
    rows = kept(df.select(id_col, vector_col), vector_col)
    size, books = _initial(rows, id_col, vector_col, parts, entries)
    for _ in range(rounds if books else 0):
        books = _refine(rows.select(vector_col), size, books)
    return size, books


def digest(books: Codebooks) -> str:
    """sha256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encode(df: DataFrame, model: tuple[int, Codebooks], vector_col: str = "embedding") -> DataFrame:
    """The kept rows of ``df`` with ``code`` (two hex digits a part) and ``error`` (squared distance).

    Rows whose vector is null or has null or non-finite components go.  A vector of
    another size than the model's stays without code and error; an error beyond a long is
    the largest long.  All columns stay, whatever their names: new names that are taken
    get an underscore.  Repeated rows each stay.
    """
    size, books = model
    bounds = part_bounds(size, len(books) or 1)
    rows = kept(df, vector_col)
    at = df.columns.index(vector_col)
    schema = T.StructType([*df.schema.fields, T.StructField(fresh("code", df), T.StringType()), T.StructField(fresh("error", df), T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b, z - a) for b, a, z in zip(books, bounds, bounds[1:], strict=False)]
        for batch in batches:
            for part in slices(batch):
                fits, values = _matrix(part.column(at), size)
                fits = fits & bool(found)
                values = integers(values)
                codes, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
                if found:
                    index, distance = zip(*(book.nearest(values[:, a:z]) for book, a, z in zip(found, bounds, bounds[1:], strict=False)), strict=True)
                    codes[fits] = ["".join(f"{i:02x}" for i in row) for row in np.stack(index, axis=1).tolist()]
                    errors[fits] = [min(sum(map(int, row)), LONG) for row in zip(*distance, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def with_group_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over rows of an equal ``key``, nulls together.

    Sums are partial aggregates.  They are broadcast when their number is proven small;
    beyond that only those of hot keys, of which there are at most ``HOT_LABELS``, and the
    rows of the rest, a bounded share each, meet their sum by a shuffle.
    """
    k = fresh("_key", df)
    sums = checkpoint(df.groupBy(F.col(key).alias(k)).agg(F.sum(F.col(value).cast("decimal(38,0)")).cast("bigint").alias(name), F.count("*").alias("_n")))
    groups, rows = sums.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.drop("_n"), F.col(key).eqNullSafe(F.col(k)), "left").drop(k)

    if groups * 64 <= BROADCAST_LIMIT:
        return joined(df, F.broadcast(sums))
    hot = sums.where(F.col("_n") * HOT_LABELS > rows)
    cold = sums.join(F.broadcast(hot.select(F.col(k).alias("_hot"))), F.col(k).eqNullSafe(F.col("_hot")), "left_anti")
    first = df.join(F.broadcast(hot.drop("_n")), F.col(key).eqNullSafe(F.col(k)), "left")
    is_hot = F.col(name).isNotNull()
    return first.where(is_hot).drop(k).unionByName(joined(first.where(~is_hot).drop(k, name), cold))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of each kept vector.

    Edge cases as in :func:`train` and :func:`encode`; rows without a label are one
    group; an empty table, or one without a usable vector, gives no rows.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"), F.col(label_col).alias("_label"))
    model = train(rows, "_id", "_vector")
    coded = checkpoint(encode(rows, model, "_vector").drop("_vector"))
    found = with_group_sum(coded, "_label", "error", "label_error")
    return found.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(model[1])).alias("codebooks_sha256"))
