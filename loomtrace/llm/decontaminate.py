"""Benchmark decontamination with an FM-index per training shard.

Words of a shard's documents become symbols of the test phrases' vocabulary.  A word
outside it ends every phrase, so only runs of known words that are long enough for some
phrase are indexed; what is left out cannot match.  The shard's FM-index is the
Burrows-Wheeler transform with ranks from a wavelet matrix and every ``SAMPLE``-th
suffix position.  All test phrases search backwards together, occurrences are located
by walking to sampled suffixes, and their spans merge into the words to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_LIMIT, blank_pieces, blobs, checkpoint, fresh, without

WINDOW = 13
#: Suffix positions kept: one in so many.
SAMPLE = 16
#: Indexed words of a shard, about.
SHARD_WORDS = 2_000_000
#: Words of a benchmark item that are dealt to a block together, about.
ITEM_WORDS = 2_000
#: Every byte that is not part of a word becomes a space; A-Z become lower case.
_WORDS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class FMIndex:
    """FM-index of an array of symbols; 0 separates texts and matches nothing."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        self.n = n = len(text)
        order = self._suffixes(text)
        bwt = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.zeros, self.ones = [], []
        row = bwt
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        sampled = order % SAMPLE == 0
        self.marked = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = order[sampled]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; the last symbol is unique and smallest."""
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        n, k = len(text), 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-k or n] = rank[k:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            in_order = key[order]
            fresh = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            k *= 2
            if fresh[-1] == n - 1 or k >= 2 * n:
                return order

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its row of the transform."""
        low, high = np.zeros_like(row), row
        for i, level in enumerate(reversed(range(self.levels))):
            bit = ((symbol >> level) & 1).astype(bool)
            one_low, one_high = self.ones[i][low], self.ones[i][high]
            low = np.where(bit, self.zeros[i] + one_low, low - one_low)
            high = np.where(bit, self.zeros[i] + one_high, high - one_high)
        return high - low

    def at(self, row: np.ndarray) -> np.ndarray:
        """Symbols of the transform at rows."""
        symbol = np.zeros_like(row)
        for i, level in enumerate(reversed(range(self.levels))):
            bit = self.ones[i][row + 1] - self.ones[i][row]
            symbol |= bit.astype(np.int64) << level
            row = np.where(bit == 1, self.zeros[i] + self.ones[i][row], row - self.ones[i][row])
        return symbol

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern, a row of equally long symbol strings."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            live = np.flatnonzero(low < high)
            symbol = patterns[live, j].astype(np.int64) + 1
            known = symbol < len(self.first) - 1
            live, symbol, lost = live[known], symbol[known], live[~known]
            high[lost] = low[lost]
            base = self.first[symbol]
            low[live], high[live] = base + self.rank(symbol, low[live]), base + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        rows, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.marked[at + 1] > self.marked[at]
            done = open_[hit]
            out[done] = self.samples[self.marked[rows[done]]] + steps[done]
            open_ = open_[~hit]
            symbol = self.at(rows[open_])
            rows[open_] = self.first[symbol] + self.rank(symbol, rows[open_])
            steps[open_] += 1
        return out


class Phrases(NamedTuple):
    """Test phrases of a block of items: windows by length, as symbols of ``vocabulary`` (from 1)."""

    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: dict[int, list[list]]

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """Distinct windows of items and the items of each; an item without words has none."""
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple, list]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((text or "").encode())]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1) if size else ():
            found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), []).append(item)
    return Phrases(vocabulary, {n: np.array(list(w), np.int32) for n, w in found.items()}, {n: [sorted(set(map(str, x))) for x in w.values()] for n, w in found.items()})


class _Shard:
    """Documents gathered for one index."""

    def __init__(self, test: Phrases):
        self.test, self.parts, self.places, self.size = test, [], [], 0
        self.n_words: list[int] = []

    def add(self, text: bytes) -> None:
        number, get, parts = len(self.n_words), self.test.vocabulary.get, [np.zeros(0, np.int32)]
        for words in blank_pieces(text.translate(_WORDS)):
            parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
        ids = np.concatenate(parts)
        self.n_words.append(len(ids))
        if not self.test.windows:
            return
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        for a, b in zip(starts[(long := ends - starts >= self.test.shortest)].tolist(), ends[long].tolist(), strict=True):
            self.parts += [ids[a:b], np.zeros(1, np.int32)]
            self.places.append((self.size, number, a))
            self.size += b - a + 1

    def spans(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Merged spans of words [from, to) to remove, and the items found, of each document."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.n_words]
        items: list[set[str]] = [set() for _ in self.n_words]
        if not self.size:
            return spans, items
        index = FMIndex(np.concatenate(self.parts))
        cover = np.zeros(self.size + 1, np.int32)
        offsets = np.array([p[0] for p in self.places])
        for size, windows in self.test.windows.items():
            low, high = index.search(windows)
            n = high - low
            hits = np.flatnonzero(n > 0)
            n = n[hits]
            which = np.repeat(hits, n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[hits], n)
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            run = np.searchsorted(offsets, at, side="right") - 1
            for w, r in set(zip(which.tolist(), run.tolist(), strict=True)):
                items[self.places[r][1]].update(self.test.items[size][w])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover) > 0, [0]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            start, number, first = self.places[int(np.searchsorted(offsets, a, side="right")) - 1]
            spans[number].append((first + a - start, first + b - start))
        return spans, items


def _dealt(tests: DataFrame, window: int) -> DataFrame:
    """``block``, ``item``, ``text``: distinct items, long ones in parts that overlap by a window less one word.

    A part keeps whole windows, and an item of fewer words than a window is one part, so
    the parts' windows are those of the items.  Blocks are made more until each of them
    takes no more than the broadcast limit.
    """
    step = max(ITEM_WORDS, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(blobs(batch.column(1))):
                words = words_of(text)
                parts = [b" ".join(words[i : i + step + window - 1]) for i in range(0, max(1, len(words) - window + 1), step)]
                for part in parts if words else ():
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([part], pa.binary()).cast(pa.string())], ["item", "text"])

    parts = checkpoint(tests.mapInArrow(cut, tests.schema).distinct())
    blocks = 1
    while True:
        dealt = parts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
        largest = dealt.groupBy("block").agg(F.sum(F.octet_length("text") + 64).alias("size")).agg(F.max("size")).first()[0] or 0
        if largest * 16 <= BROADCAST_LIMIT or blocks > 1 << 20:
            return dealt
        blocks *= 2


def find_spans(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_col``, ``n_words``, ``spans`` (words [from, to) to remove), ``items`` (item ids as strings).

    Null texts have no words; null item texts give no window, a null item id reads as
    ``None``; repeated rows stay, as do their results; empty tables on either side give
    no rows or no spans; only the named columns are read.

    The phrases of a benchmark are broadcast: whole if small, else in blocks, each of
    measured size, with one pass over the distinct texts for each block; the blocks'
    results of a text are joined at the end.
    """
    tests = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    dealt = None if size * 16 <= BROADCAST_LIMIT else _dealt(tests, window)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, spans array<struct<from:int,to:int>>, items array<string>"

    def scan(source: DataFrame, block: int) -> DataFrame:
        part = tests if dealt is None else dealt.where(F.col("block") == block).select("item", "text")
        shared = df.sparkSession.sparkContext.broadcast(phrases([tuple(r) for r in part.collect()], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, shard = [], _Shard(shared.value)

            def result() -> pa.RecordBatch:
                spans, items = shard.spans()
                out = [pa.array(shard.n_words, pa.int64()), pa.array([[{"from": a, "to": b} for a, b in s] for s in spans], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *out], [id_col, "n_words", "spans", "items"])

            for batch in batches:
                texts, at = blobs(batch.column(1)), 0
                for i, text in enumerate(texts):
                    shard.add(text)
                    if shard.size > SHARD_WORDS:
                        ids.append(batch.column(0).slice(at, i + 1 - at))
                        at = i + 1
                        yield result()
                        ids, shard = [], _Shard(shared.value)
                if at < len(texts):
                    ids.append(batch.column(0).slice(at))
            if ids:
                yield result()

        return source.mapInArrow(run, schema)

    if dealt is None:
        return scan(df.select(id_col, text_col), 0)
    # each block scans distinct texts under a digest; the parts of a text meet by it
    keyed = df.select(F.col(id_col), F.sha2(F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\0")), 256).alias(key := fresh("k", df)))
    texts = df.select(F.sha2(F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\0")), 256).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).distinct()
    kind = "string"
    schema = f"`{id_col}` string, n_words bigint, spans array<struct<from:int,to:int>>, items array<string>"
    texts, parts = checkpoint(texts), None
    for block in sorted(r[0] for r in dealt.select("block").distinct().collect()) or [0]:
        found = scan(texts, block)
        parts = found if parts is None else parts.unionByName(found)
    whole = parts.groupBy(F.col(id_col).alias(key)).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return keyed.join(whole, key).select(id_col, "n_words", _merged(F.col("spans")).alias("spans"), "items")


def _merged(spans):
    """Union of sorted half-open spans."""

    def step(done, s):
        joins = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["to"], F.lit(-1)) >= s["from"])
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["from"].alias("from"), F.greatest(F.try_element_at(done, F.lit(-1))["to"], s["to"]).alias("to"))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<from:int,to:int>>)"), step)


def report(df: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``find_spans`` as counts: words, words hit, items, their digest, and the verdict.

    A document is contaminated if words are hit and they are a twentieth of it or more.
    """
    id_col = columns.get("id_col", "doc_id")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    out = find_spans(df, benchmark, **columns).select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that are not contaminated, all columns as they were, whatever their names.

    The verdict is one on the text, so it goes back to rows by the text's digest.  Null
    and empty texts have no words and stay, as do repeats of what stays; empty tables on
    either side remove nothing.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    verdicts = report(df.select(digest.alias("_digest"), text_col), benchmark, id_col="_digest", text_col=text_col)
    return without(df, digest, verdicts.where("contaminated").select("_digest"))
