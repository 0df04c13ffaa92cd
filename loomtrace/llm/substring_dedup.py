"""Removal of repeated passages, with suffix trees partitioned by prefix.

Suffixes are cut off at ``WINDOW`` words, as nothing below that depth matters: two
places repeat each other when their suffixes share a node of that depth.  All suffixes
together are far more than one tree can hold, so they are dealt to groups by a prefix:

* the short prefix of a suffix is its anchor, the least of its runs of ``ANCHOR`` words
  by hash (so it is read from its anchor on, not from its first word: equal suffixes have
  equal anchors all the same, and neighbours mostly share theirs, so that one record
  carries a stretch of neighbouring suffixes and their words once);
* groups are counted first, over all texts.  One that would pass ``GROUP_BYTES`` has its
  prefix lengthened to the whole suffix, as far as equal suffixes allow, and is split
  into as many groups as its size asks for.

In each group a tree is built from the root down, a level at a time: suffixes part by
their prefix first and then by their next words, and a node with a single suffix is a
leaf that no further level looks at.  The nodes that are left at the depth of a window
are the repeats; of the places below one the first stays, and neighbouring places join to
maximal spans.

Equal stretches of one map task are sent once: of two of them the later is known to be a
repeat at once.  So what a group holds of one text is at most one record a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BROADCAST_LIMIT, blank_pieces, blobs, checkpoint, fresh, slices

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 20, 3
#: Bytes of the stretches of a group, on average at most half of that, and of a partition of groups.
GROUP_BYTES, PART_BYTES = 16 << 20, 64 << 20
#: Bytes of stretches for each byte of text, about, and of windows of their own for each byte of stretches.
SPREAD, APART = 3, 7
#: Words that a task works on at a time, bytes of stretches that it holds, and stretches and hashes that it remembers.
BLOCK_WORDS, HELD_BYTES, REMEMBERED, HASHES = 60_000, 32 << 20, 150_000, 300_000

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: What a stretch is besides its words: is its id null, id, digest of the text, first word, number of windows, mark of its prefix, bytes.
_STRETCH = [("null", np.uint8), ("id", np.int64), ("digest", np.int64), ("start", np.int64), ("n", np.int32), ("mark", np.uint32), ("size", np.int32)]
_SPAN = "null boolean, id bigint, digest bigint, start bigint, end bigint"


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHES:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _least(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``span`` neighbouring values and where it stands first."""
    at, size = np.arange(len(values), dtype=np.int64), 1
    while size < span:
        step = min(size, span - size)
        later = values[step:] < values[:-step]
        values, at = np.where(later, values[step:], values[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    return values, at


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(_ODD[1])
    return values ^ (values >> np.uint64(32))


def _run_hash(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many words."""
    factor, total = np.uint64(_ODD[0]), np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        total = total * factor + hashes[k : len(hashes) - words + 1 + k]
    return _mixed(total)


class Groups:
    """Which group a window belongs to: that of its anchor, or, where that one is large, that of its whole text."""

    def __init__(self, number: int, large: list[int] | None = None, splits: list[int] | None = None, everything: bool = False):
        self.number, self.everything = number, everything
        order = np.argsort(large or [])
        self.large, self.splits = np.array(large or [], np.int64)[order], np.array(splits or [], np.int64)[order]
        self.first = number + np.cumsum(self.splits) - self.splits

    def of(self, anchors: np.ndarray, whole) -> tuple[np.ndarray, np.ndarray]:
        """Groups of windows and the hashes of their prefixes; ``whole`` gives hashes of their whole texts, if asked for."""
        if self.everything:
            prefix = whole()
            return (prefix % np.uint64(self.number * APART)).astype(np.int64), prefix
        group, prefix = (anchors % np.uint64(self.number)).astype(np.int64), anchors
        if len(self.large):
            at = np.minimum(np.searchsorted(self.large, group), len(self.large) - 1)
            hot = self.large[at] == group
            if hot.any():
                prefix = np.where(hot, whole(), prefix)
                group[hot] = self.first[at[hot]] + (prefix[hot] % self.splits[at[hot]].astype(np.uint64)).astype(np.int64)
        return group, prefix


class Stretches:
    """Stretches of neighbouring windows of one group, over the texts of a task, block by block."""

    def __init__(self, groups: Groups, window: int):
        self.groups, self.window, self.hashes = groups, window, _Hashes()

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Parts of texts: (is the id null, id, digest, number of the first word, words), of bounded length together."""
        held, size = [], 0
        for part in (p for batch in batches for p in slices(batch)):
            for doc, digest, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), blobs(part.column(2)), strict=True):
                at, rest = 0, []
                for words in blank_pieces(text):
                    words = rest + words
                    if len(words) < self.window:
                        rest = words
                        continue
                    held.append((doc is None, doc or 0, digest, at, words))
                    # the next part begins with the windows that this one cuts off
                    rest = words[len(words) - self.window + 1 :]
                    at, size = at + len(words) - len(rest), size + len(words)
                    if size >= BLOCK_WORDS:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def cut(self, held: list[tuple]) -> tuple:
        """Stretches of a block: numbers of their parts, groups, first words, windows, marks of their prefixes, byte ranges; and the words of all parts."""
        words = [w for *_, part in held for w in part]
        sizes = np.array([len(part) for *_, part in held])
        ends = np.cumsum(sizes)
        hashes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=offsets[1:])
        least, where = _least(_run_hash(hashes, ANCHOR), self.window - ANCHOR + 1)
        part = np.repeat(np.arange(len(held)), sizes)[: len(least)]
        inside = np.flatnonzero(np.arange(len(least)) + self.window <= ends[part])
        least, where = least[inside], where[inside]
        group, prefix = self.groups.of(least, lambda: _run_hash(hashes, self.window)[inside])
        fresh_ = np.ones(len(inside), bool)
        fresh_[1:] = (inside[1:] != inside[:-1] + 1) | (where[1:] != where[:-1]) | (prefix[1:] != prefix[:-1])
        begin = np.flatnonzero(fresh_)
        n = np.diff(np.append(begin, len(inside)))
        first = inside[begin]
        mark = (prefix[begin] >> np.uint64(32)).astype(np.uint32)  # groups take the lower bits
        return part[first], group[begin], first - (ends - sizes)[part[first]], n, mark, offsets[first], offsets[first + n + self.window - 1] - 1, b" ".join(words)


def _count_groups(texts: DataFrame, groups: Groups, window: int) -> DataFrame:
    """``bucket``, ``bytes``: what each group of short prefixes would hold, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, held = Stretches(groups, window), {}
        for block in stretches.blocks(batches):
            _, group, _, _, _, low, high, _ = stretches.cut(block)
            found, at = np.unique(group, return_inverse=True)
            for g, size in zip(found.tolist(), np.bincount(at, weights=high - low + 37).astype(np.int64).tolist(), strict=True):
                held[g] = held.get(g, 0) + size
            if len(held) > HASHES:
                yield _columns(held)
                held = {}
        yield _columns(held)

    def _columns(held: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["bucket", "bytes"])

    return texts.mapInArrow(run, "bucket bigint, bytes bigint").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))


def group_plan(texts: DataFrame, window: int) -> Groups:
    """Prefixes of the groups, from counts over all texts.  Only large groups reach the driver, while they are few."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(texts.columns[2])), F.lit(0))).first()[0]
    plain = Groups(max(16, -(-SPREAD * size * 2 // GROUP_BYTES)))
    large = checkpoint(_count_groups(texts, plain, window).where(F.col("bytes") > GROUP_BYTES))
    if large.count() * 24 > BROADCAST_LIMIT:
        return Groups(plain.number, everything=True)
    found = large.collect()
    return Groups(plain.number, [r.bucket for r in found], [-(-r.bytes * APART * 2 // GROUP_BYTES) for r in found])


def _pack(records: list[tuple]) -> tuple[bytes, int]:
    """Stretches as columns and their words, compressed; and the size before."""
    columns = [np.array(c, kind).tobytes() for (_, kind), c in zip(_STRETCH, zip(*(r[:-1] for r in records), strict=True), strict=True)]
    raw = len(records).to_bytes(8, "little") + b"".join(columns) + b" ".join(r[-1] for r in records)
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(packed: bytes, size: int) -> tuple[dict[str, np.ndarray], bytes]:
    raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    n, at, columns = int.from_bytes(raw[:8], "little"), 8, {}
    for name, kind in _STRETCH:
        columns[name] = np.frombuffer(raw, kind, n, at)
        at += columns[name].nbytes
    return columns, raw[at:]


_PACKED = "bucket bigint, repeats boolean, packed binary, size bigint"


def _dealt(texts: DataFrame, groups: Groups, window: int) -> DataFrame:
    """Packed stretches of each group, and packed spans that a task knows to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, first = Stretches(groups, window), {}
        held, gone, size = defaultdict(list), [], 0
        for block in stretches.blocks(batches):
            of, group, start, n, mark, low, high, joined = stretches.cut(block)
            for k, g, s, m, r, a, z in zip(of.tolist(), group.tolist(), start.tolist(), n.tolist(), mark.tolist(), low.tolist(), high.tolist(), strict=True):
                null, doc, digest, at, _ = block[k]
                words, me = joined[a:z], (null, doc, digest, at + s)
                key = xxhash.xxh3_128_digest(words)
                known = first.get(key)
                if known == me:
                    continue  # a repeated row
                if known is not None and known < me:
                    if gone and gone[-1][:3] == me[:3] and gone[-1][3] <= me[3] <= gone[-1][3] + gone[-1][4]:
                        gone[-1] = *me[:3], gone[-1][3], me[3] + m + window - 1 - gone[-1][3], 0, 0, b""
                    else:
                        gone.append((*me, m + window - 1, 0, 0, b""))
                    size += 37
                    continue
                if len(first) >= REMEMBERED:
                    first.clear()
                first[key] = me
                held[g].append((*me, m, r, len(words), words))
                size += len(words) + 200  # the objects of a record
            if size > HELD_BYTES:
                yield flushed(held, gone)
                held, gone, size = defaultdict(list), [], 0
        yield flushed(held, gone)

    def flushed(held: dict, gone: list) -> pa.RecordBatch:
        # spans go with the group of their first one's digest: any will do
        rows = [(g, False, *_pack(r)) for g, r in held.items()] + ([(gone[0][2] % groups.number, True, *_pack(gone))] if gone else [])
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.bool_(), pa.binary(), pa.int64()))], ["bucket", "repeats", "packed", "size"])

    return texts.mapInArrow(run, _PACKED)


def _deeper(upper: np.ndarray, lower: np.ndarray, shift: int, depth: int, left: np.ndarray) -> np.ndarray:
    """Nodes at ``depth``: children of ``upper`` (at depth ``shift``) by the node that the rest leads to; leaves are -1."""
    found = np.full(len(upper), -1, np.int64)
    at = np.flatnonzero((upper >= 0) & (left >= depth))
    at = at[lower[at + shift] >= 0]
    if len(at):
        _, node, n = np.unique(upper[at] * (int(lower.max()) + 1) + lower[at + shift], return_inverse=True, return_counts=True)
        found[at] = np.where(n[node] > 1, node, -1)
    return found


def deep_nodes(words: list[bytes], sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word of some texts the node of depth ``window`` that its suffix passes, -1 where it is alone there.

    The tree grows from the root; a level doubles the depth, and only suffixes of inner
    nodes go on.
    """
    number = defaultdict(count().__next__)
    node = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if not len(words):
        return node
    node[np.bincount(node)[node] < 2] = -1
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    levels, depth = {1: node}, 1
    while 2 * depth <= window:
        levels[2 * depth] = _deeper(levels[depth], levels[depth], depth, 2 * depth, left)
        depth *= 2
    found, at = levels[depth], depth
    while at < window:
        depth = max(d for d in levels if d <= window - at)
        found = _deeper(found, levels[depth], at, at + depth, left)
        at += depth
    return found


def _repeats(parts: list[tuple[dict[str, np.ndarray], bytes]], window: int) -> Iterator[pa.RecordBatch]:
    """Spans of a group's stretches that repeat an earlier place."""
    of = {name: np.concatenate([c[name] for c, _ in parts]) for name, _ in _STRETCH}
    # the first level: a prefix that one stretch alone has is a leaf below the root
    _, mark, n = np.unique(of["mark"], return_inverse=True, return_counts=True)
    shared = n[mark] > 1
    if not shared.any():
        return
    starts = np.concatenate([np.cumsum(c["size"].astype(np.int64) + 1) - c["size"] - 1 for c, _ in parts])
    source = np.repeat(np.arange(len(parts)), [len(c["size"]) for c, _ in parts])
    words = b" ".join(parts[k][1][a : a + z] for k, a, z in zip(source[shared].tolist(), starts[shared].tolist(), of["size"][shared].tolist(), strict=True)).split(b" ")
    of = {name: c[shared] for name, c in of.items()}
    sizes = of["n"].astype(np.int64) + window - 1
    node = deep_nodes(words, sizes, window)
    del words
    place = np.flatnonzero(node >= 0)
    if not len(place):
        return
    stretch = np.repeat(np.arange(len(sizes)), sizes)[place]
    key = [of[c][stretch] for c in ("null", "id", "digest")] + [of["start"][stretch] + place - (np.cumsum(sizes) - sizes)[stretch]]
    node = node[place]
    order = np.lexsort((*key[::-1], node))
    node, stretch, key = node[order], stretch[order], [k[order] for k in key]
    head = np.maximum.accumulate(np.where(np.append(True, node[1:] != node[:-1]), np.arange(len(node)), 0))
    later = np.any([k != k[head] for k in key], axis=0)  # a repeated row is no later place
    stretch, at = stretch[later], key[3][later]
    order = np.lexsort((at, stretch))
    stretch, at = stretch[order], at[order]
    if not len(at):
        return
    first = np.append(True, (stretch[1:] != stretch[:-1]) | (at[1:] != at[:-1] + 1))
    last = np.append(first[1:], True)
    yield _spans(of, stretch[first], at[first], at[last] + window)


def _spans(of: dict[str, np.ndarray], rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(of["null"][rows].astype(bool)), pa.array(of["id"][rows]), pa.array(of["digest"][rows]), pa.array(start), pa.array(end)], ["null", "id", "digest", "start", "end"])


def repeated_spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``null``, ``id``, ``digest``, ``start``, ``end``: words that repeat an earlier place; spans of a text may overlap.

    ``texts`` has an id, a digest that tells texts of one id apart, and the text.
    """
    groups = group_plan(texts, window)
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups.number * GROUP_BYTES // (2 * PART_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            for bucket, known, packed, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known:
                    of, _ = _unpack(packed, size)
                    yield _spans(of, np.arange(len(of["n"])), of["start"], of["start"] + of["n"])
                    continue
                if bucket != group and held:
                    yield from _repeats(held, window)
                    held = []
                group = bucket
                held.append(_unpack(packed, size))
        if held:
            yield from _repeats(held, window)

    return _dealt(texts, groups, window).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _SPAN)


def _merged(spans: DataFrame) -> DataFrame:
    """One row a text with spans: those that touch are one."""
    both = spans.groupBy("null", "id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    both = both.select("null", "id", "digest", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for starts, ends in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                start, end = np.array(starts), np.maximum.accumulate(ends)
                first = np.append(True, start[1:] > end[:-1])
                found.append(np.stack([start[first], end[np.append(first[1:], True)]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["null", "id", "digest", "spans"])

    return both.mapInArrow(run, "null boolean, id bigint, digest bigint, spans array<bigint>")


def _kept(text: bytes, spans: list[int]) -> tuple[int, int, bytes]:
    """Words of a text, words that its spans (start, end, start, end ...) remove, and the rest, joined by blanks."""
    at, kept, n_kept = 0, [], 0
    bounds, k = [*spans, 1 << 62], 0
    for words in blank_pieces(text):
        end, here = at + len(words), at
        while here < end:
            stop = min(bounds[k], end)
            if k % 2 == 0 and stop > here:
                kept.append(b" ".join(words[here - at : stop - at]))
                n_kept += stop - here
            here = max(stop, here)
            if here == bounds[k]:
                k += 1
        at = end
    return at, at - n_kept, b" ".join(kept)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``df`` with ``n_words``, ``n_removed``, ``kept`` and ``spans`` (removed words: start, end, start, end ...).

    Words are what white space parts.  A word goes if a window of ``window`` words over it
    stands at an earlier place too: in a text of a smaller id, or before in the same text.
    Null and empty texts have no words.  Null ids come last; texts of one id are ordered
    by a digest; rows of one id and text are one document, which is judged once.  Ids are
    integers.  An empty table gives no rows; new names that ``df`` has get an underscore.
    """
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col}: ids must be integers")
    text, doc = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("bigint")
    texts = df.select(doc.alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    found = checkpoint(_merged(repeated_spans(texts, window)))
    size = found.agg(F.coalesce(F.sum(F.lit(64) + 8 * F.size("spans")), F.lit(0))).first()[0]

    names = [fresh(n, df) for n in ("_null", "_id", "_digest", "_spans")]
    found = found.select(*[F.col(c).alias(n) for c, n in zip(found.columns, names, strict=True)])
    same = (doc.isNull() == F.col(names[0])) & (F.coalesce(doc, F.lit(0).cast("bigint")) == F.col(names[1])) & (F.xxhash64(text) == F.col(names[2]))
    joined = df.join(F.broadcast(found) if size <= BROADCAST_LIMIT else found, same, "left").drop(*names[:3])
    at, (a, b, c, d) = df.columns.index(text_col), (fresh(n, df) for n in ("n_words", "n_removed", "kept", "spans"))
    schema = T.StructType([*df.schema.fields, T.StructField(a, T.LongType()), T.StructField(b, T.LongType()), T.StructField(c, T.StringType()), T.StructField(d, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            *columns, spans = part.columns
            spans = [s or [] for s in spans.to_pylist()]
            n, gone, kept = zip(*map(_kept, blobs(part.column(at)), spans), strict=True)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.int64()))], schema.names)

    return joined.mapInArrow(run, schema)
