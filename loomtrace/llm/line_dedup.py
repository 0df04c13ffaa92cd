"""Line deduplication with two Bloom filters.

Tasks enter the hashes of their documents' lines into two filters: places seen once, and
places seen twice or more.  Tasks' filters merge by OR; a place that is in the first
filter of two tasks goes to the merged second one, so every hash that stands in two
documents has all its places there, in whatever order filters meet.  Nothing but the
filters moves.  Lines whose hash the second filter holds are suspected repeats; only
these shuffle, to be confirmed exactly by the digest of their key and the number of
documents, and only keys confirmed in enough documents drop lines.

The filters are sized by the counted number of lines.  Where they would pass
``MAP_BITS``, line hashes (8 bytes, once a task) are dealt to shards instead, as many as
the count asks for, each with a filter of its own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ASCII_LOWER, BROADCAST_LIMIT, blobs, checkpoint, fresh, slices

#: Bits of a filter for each counted line.  A filter with more lines only suspects more.
LINE_BITS = 8
#: Bits of the largest filter that tasks build whole, of one that moves as a unit, and of the filter of a shard.
MAP_BITS, PIECE_BITS, FILTER_BITS = 1 << 28, 1 << 20, 1 << 26
#: Distinct lines that a task counts before it hands them on.
HELD_LINES = 400_000
_BLANK = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """Key of a line: blanks stripped at both ends, A-Z lower-cased."""
    return line.strip(_BLANK).translate(ASCII_LOWER)


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 7)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=20).digest()


class Bloom:
    """A Bloom filter over 64-bit hashes for whole arrays: one place in each half of its bits."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits >> 6, np.uint64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, two rows."""
        mixed, half = hashes * np.uint64(0x9E3779B97F4A7C15), np.uint64(self.bits >> 1)
        return np.stack([(mixed >> np.uint64(32)) % half, (mixed & np.uint64(0xFFFFFFFF)) % half + half])

    def holds(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)

    def mark(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.words, places >> np.uint64(6), np.uint64(1) << (places & np.uint64(63)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.holds(self.places(hashes)).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        self.mark(self.places(hashes).ravel())


class Seen:
    """Two filters of one size: places seen once, and places seen twice or more."""

    def __init__(self, bits: int):
        self.once, self.twice = Bloom(bits), Bloom(bits)

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """Enter distinct hashes; those marked ``again`` were seen in two documents or more."""
        places = self.once.places(hashes)
        each, n = np.unique(np.concatenate([places.ravel(), places[:, again].ravel()]), return_counts=True)
        self.twice.mark(each[(n > 1) | self.once.holds(each)])
        self.once.mark(each)

    def merge(self, once: np.ndarray, twice: np.ndarray, at: int = 0) -> None:
        """Add the words of another pair, from a word on."""
        mine, repeated = (f.words[at : at + len(once)] for f in (self.once, self.twice))
        repeated |= twice | (mine & once)
        mine |= once


def _filter_bits(df: DataFrame, text_col: str) -> int:
    """Bits for all lines of a table, repeats counted: a power of two."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = df.agg(F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1), F.lit(0))).first()[0]
    return 1 << max(16, (LINE_BITS * int(lines)).bit_length())


def _counted(texts: Iterator[list[bytes]], wanted: Callable[[list[bytes]], list[bytes]]) -> Iterator[Counter]:
    """Documents in which each wanted key stands, in parts of bounded size."""
    held: Counter = Counter()
    for batch in texts:
        for text in batch:
            held.update(wanted(list({k for line in text.split(b"\n") if (k := line_key(line))})))
            if len(held) > HELD_LINES:
                yield held
                held = Counter()
    yield held


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct line hashes of a task, in parts, and which of them stand in two documents or more."""
    for held in _counted((blobs(b.column(0)) for b in chain.from_iterable(map(slices, batches))), lambda keys: [_hash(k) for k in keys]):
        yield np.fromiter(held.keys(), np.uint64, len(held)), np.fromiter((n > 1 for n in held.values()), bool, len(held))


def repeated_filter(df: DataFrame, text_col: str, bits: int) -> Bloom:
    """The filter of places seen twice, over all lines of ``df``.

    Each task sends the pieces of its two filters, compressed; a piece is merged in one
    task, whose memory is that of its pieces.  What reaches the driver is ``bits`` bits.
    """
    piece = min(bits, PIECE_BITS) >> 6

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(bits)
        for hashes, again in _hashes(batches):
            seen.add(hashes, again)
        for at in range(0, bits >> 6, piece):
            once, twice = (f.words[at : at + piece] for f in (seen.once, seen.twice))
            if once.any():
                packed = [pa.array([pa.compress(w.tobytes(), codec="zstd", asbytes=True)], pa.binary()) for w in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *packed], ["at", "once", "twice"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Seen] = {}
        for batch in batches:
            for at, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [np.frombuffer(pa.decompress(w, decompressed_size=piece * 8, codec="zstd", asbytes=True), np.uint64) for w in packed]
                held.setdefault(at, Seen(piece << 6)).merge(*words)
        for at, seen in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([seen.twice.words.tobytes()], pa.binary())], ["at", "twice"])

    found = Bloom(bits)
    for at, words in df.select(text_col).mapInArrow(built, "at int, once binary, twice binary").repartition("at").mapInArrow(merged, "at int, twice binary").collect():
        found.words[at : at + piece] = np.frombuffer(words, np.uint64)
    return found


def _suspects(lines: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Hashes that the filter of one shard may hold already, once a batch."""
    seen = Bloom(bits)
    for batch in lines:
        hashes, first, n = np.unique(batch.column(0).to_numpy().view(np.uint64), return_index=True, return_counts=True)
        again = (n > 1) | batch.column(1).to_numpy(zero_copy_only=False)[first] | seen.has(hashes)
        seen.add(hashes)
        repeated = hashes[again]
        if len(repeated):
            yield pa.RecordBatch.from_arrays([pa.array(repeated.view(np.int64))], ["h"])


def suspected(df: DataFrame, text_col: str = "text", shards: int = 1) -> DataFrame:
    """``h``, distinct: hashes of lines that may stand in two documents or more (all that do, and few others), by shards."""
    bits = FILTER_BITS

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, again in _hashes(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(again, pa.bool_())], ["h", "again"])

    dealt = df.select(text_col).mapInArrow(hashes, "h bigint, again boolean").repartition(shards, "h")
    return dealt.mapInArrow(lambda lines: _suspects(lines, bits), "h bigint").distinct()


def _bounded(df: DataFrame, column: str, width: int) -> list | None:
    """All values of a column if they fit the broadcast limit, else None."""
    n = df.count()
    return [r[0] for r in df.select(column).collect()] if n * width <= BROADCAST_LIMIT else None


def frequent_lines(df: DataFrame, least: int = 10, text_col: str = "text") -> DataFrame:
    """``digest``, ``n_docs`` of the keys that stand in at least ``least`` rows of ``df``."""
    bits = _filter_bits(df, text_col)
    spark = df.sparkSession
    if whole := bits <= MAP_BITS:
        shared = spark.sparkContext.broadcast(repeated_filter(df, text_col, bits))
    else:
        found = checkpoint(suspected(df, text_col, -(-bits // FILTER_BITS)))

    def picked(keys: list[bytes]) -> list[bytes]:
        if not whole or not keys:
            return keys
        return list(compress(keys, shared.value.has(np.fromiter(map(_hash, keys), np.uint64, len(keys)))))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _counted((blobs(b.column(0)) for b in chain.from_iterable(map(slices, batches))), picked):
            h = np.fromiter(map(_hash, part), np.uint64, len(part)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([_digest(k) for k in part], pa.binary()), pa.array(list(part.values()), pa.int64())], ["h", "digest", "n"])

    lines = df.select(text_col).mapInArrow(candidates, "h bigint, digest binary, n bigint")
    if not whole:
        lines = lines.join(found, "h", "left_semi")
    return lines.groupBy("digest").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= least)



def drop_frequent_lines(df: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col``, ``n_lines``, ``n_dropped`` and ``kept`` text.

    A row is a document; texts split at ``\\n`` (null or empty: one empty line).  A key
    of at least one character that stands in ``least`` documents or more loses all its
    lines; a line of blanks has no key and stays.  Repeated rows each count and stay; an
    empty table gives an empty result; no other column is read.
    """
    found, lines = _with_kept(df.select(id_col, text_col), least, text_col)
    return found.select(id_col, *[F.col(f"`{lines}`.{c}").alias(c) for c in ("n_lines", "n_dropped", "kept")])


def clean(df: DataFrame, least: int = 10, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df``, whatever their names, its texts without the lines to drop.

    Edge cases as in :func:`drop_frequent_lines`; a null text becomes the empty text.
    """
    found, lines = _with_kept(df, least, text_col)
    return found.select(*[F.col(f"`{lines}`.kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def _with_kept(df: DataFrame, least: int, text_col: str) -> tuple[DataFrame, str]:
    """``df`` with a struct (n_lines, n_dropped, kept), and the name of that column.

    Confirmed keys are broadcast when they are proven to fit; beyond that the keys of
    each text are joined with them instead, and the lines to drop go back to the texts.
    """
    hot = checkpoint(frequent_lines(df, least, text_col))
    held = _bounded(hot, "digest", 20)
    at = df.columns.index(text_col)

    def kept(texts: list[bytes], drops: Callable[[int], set | frozenset]) -> pa.Array:
        n_lines, n_dropped, stays = [], [], []
        for i, text in enumerate(texts):
            lines, drop = text.split(b"\n"), drops(i)
            stay = [x for x in lines if not (k := line_key(x)) or _digest(k) not in drop] if drop else lines
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            stays.append(b"\n".join(stay))
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(stays, pa.binary()).cast(pa.string())], ["n_lines", "n_dropped", "kept"])

    lines = T.StructType().add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    result = fresh("lines", df)
    schema = T.StructType([*df.schema.fields, T.StructField(result, lines)])
    names = schema.names
    if held is not None:
        shared = df.sparkSession.sparkContext.broadcast(frozenset(map(bytes, held)))

        def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop = shared.value
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, kept(blobs(batch.column(at)), lambda i: drop)], names)

        return df.mapInArrow(filtered, schema), result

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in set(blobs(batch.column(0))):
                keys = list({_digest(k) for line in text.split(b"\n") if (k := line_key(line))})
                yield pa.RecordBatch.from_arrays([pa.array([_digest(text)] * len(keys), pa.binary()), pa.array(keys, pa.binary())], ["text_key", "digest"])

    text_key, dropped = fresh("text_key", df), fresh("drops", df)
    drops = df.select(text_col).mapInArrow(exploded, "text_key binary, digest binary").join(hot.select("digest"), "digest").distinct()
    drops = drops.groupBy(F.col("text_key").alias(text_key)).agg(F.collect_list("digest").alias(dropped))
    keyed = T.StructType([*df.schema.fields, T.StructField(text_key, T.BinaryType())])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(t) for t in blobs(batch.column(at))], pa.binary())], keyed.names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, each = batch.columns
            each = each.to_pylist()
            yield pa.RecordBatch.from_arrays([*columns, kept(blobs(batch.column(at)), lambda i, each=each: set(each[i] or ()))], names)

    texts = df.mapInArrow(key, keyed)
    return texts.join(drops, text_key, "left").select(*[F.col(f"`{c}`") for c in df.columns], dropped).mapInArrow(joined, schema), result
