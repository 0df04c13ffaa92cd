"""Byte-level BPE, encoding and decoding.

Each pre-token is a doubly linked list of symbols.  A heap holds (merge rank, position)
for every adjacent pair that the vocabulary can merge; the lowest rank, leftmost first,
is taken, entries whose symbols have since changed are stale and skipped, and the
merged symbol offers new pairs to both sides.  Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import PIECE, map_batches, pieces, strings

#: The pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept with their ids, and the longest kept.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


#: Letters and numbers of Unicode 16, as first and last code point.
UNICODE_16 = """
1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d40-10d65 10d6f-10d85 10ec2-10ec4 11380-11389
1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 116d0-116e3
11bc0-11be0 11bf0-11bf9 13460-143fa 16100-1611d 16130-16139 16d40-16d6c 16d70-16d79
18cff-18cff 1ccf0-1ccf9 1e5d0-1e5ed 1e5f0-1e5fa
"""


@lru_cache(maxsize=1)
def _newer_than_library() -> dict[int, str]:
    """Letters and numbers of Unicode versions after the library's, each -> a private-use stand-in.

    The library follows Unicode 16; ``regex`` knows more, :mod:`unicodedata` less.
    """
    known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    newer = {ord(c) for c in known if unicodedata.category(c) == "Cn"}
    for span in UNICODE_16.split():
        first, last = (int(x, 16) for x in span.split("-"))
        newer.difference_update(range(first, last + 1))
    return dict.fromkeys(newer, "\ue000")


class _Ids(dict):
    """Pre-token -> its ids as packed little-endian uint32, computed on first use."""

    def __init__(self, codec: ByteBPE):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.codec.merge(word.encode()), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = packed
        return packed


class ByteBPE:
    """Encoder and decoder of one ``tokenizers`` JSON file with a byte-level BPE model.

    A file with rules that this module does not follow is refused.
    """

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        marks = any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        if not plain or not split or marks or spec.get("normalizer") or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without normalizer, prefix space, subword marks and stripping special tokens is supported")
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbol = byte_symbols()
        self.byte_id = [vocab[s] for s in symbol]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left], vocab[right]] = rank, vocab[left + right]
        back = {s: b for b, s in enumerate(symbol)}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for piece, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in piece)
        for piece, i in self.special.items():
            self.strings[i] = piece.encode()
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pattern = regex.compile(PRE_TOKEN)
        self.newer = _newer_than_library()
        self.beyond = re.compile(f"[^\0-{chr(min(self.newer, default=0x10FFFF) - 1)}]").search
        self.ids = _Ids(self)

    def words(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text without special strings, in lists of bounded length."""
        if not self.beyond(text) or self.newer.keys().isdisjoint(map(ord, text)):
            yield from pieces(self.pattern, text)
            return
        found = self.pattern.finditer(text.translate(self.newer))
        while part := [text[m.start() : m.end()] for m in islice(found, PIECE)]:
            yield part

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if found := self.pairs.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := self.pairs.get((merged, ids[k])):
                    heapq.heappush(heap, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := self.pairs.get((ids[h], merged))):
                heapq.heappush(heap, (found[0], h, ids[h], merged, found[1]))
        return [x for x in ids if x >= 0]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32; special strings are special tokens."""
        out, at = [], 0
        for m in self.split.finditer(text) if self.special else ():
            out += [b"".join(map(self.ids.__getitem__, part)) for part in self.words(text[at : m.start()])]
            out.append(np.uint32(self.special[m[0]]).tobytes())
            at = m.end()
        out += [b"".join(map(self.ids.__getitem__, part)) for part in self.words(text[at:] if at else text)]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids, concatenated; broken UTF-8 shows as U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(definition: bytes) -> ByteBPE:
    """One codec for each definition and Python worker."""
    return ByteBPE(definition)


def _definition(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` of every row's whole text.

    Null texts encode as empty (no ids); repeated rows stay; null ids pass through; an
    empty table gives an empty result; no other column is read, so none can clash.
    The vocabulary file is read on the driver and broadcast (a few MB, whatever the data).
    """
    shared = df.sparkSession.sparkContext.broadcast(_definition(path))

    def make():
        codec = load(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [codec.encode_packed(t) for t in strings(batch.column(1))]
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat)], [id_col, "n_tokens", "ids"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of every row's token ids; null ids decode as the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(_definition(path))

    def make():
        codec = load(shared.value)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, ids_col), make, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: token count and digests of both directions.

    One pass and no shuffle; edge cases as in :func:`encode`.
    """
    shared = df.sparkSession.sparkContext.broadcast(_definition(path))

    def make():
        codec = load(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, ids, decoded = [], [], []
            for text in strings(batch.column(1)):
                packed = codec.encode_packed(text)
                sizes.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(np.frombuffer(packed, "<u4").tolist()).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
