"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has a sparse random index vector, drawn from its hash; its word vector is the
sum of the index vectors of its neighbours over all documents, scaled to unit length.
Words that make up one in ``SHARE`` of all tokens or more have a row of their own, so
there are at most ``SHARE`` of them whatever the data; rarer words share ``BUCKETS``
rows by hash.  A document is the mean of its words' vectors.  A two-layer network in
numpy turns that into a probability, with a temperature fitted on labelled rows kept out
of its training.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, map_batches, pieces, slices, strings

#: Words with a row of their own at most, rows of the rest, dimensions, non-zero entries of an index vector, neighbours to each side.
SHARE, BUCKETS, DIMS, NONZERO, REACH = 200_000, 1 << 14, 48, 2, 2
#: Labelled rows that the network is fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Hidden units, epochs, rows a step, step size, share of the sample kept for the temperature.
HIDDEN, EPOCHS, BATCH, RATE, HELD = 32, 40, 256, 0.01, 5
THRESHOLD = 0.3
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_PART = 200_000
#: Words that a task counts before it hands them on.
COUNTED = 100_000


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 5)


class Rows(dict):
    """Word -> its row of the table of vectors; ``words`` are the sorted hashes of those with a row of their own."""

    def __init__(self, words: np.ndarray, shared: int):
        super().__init__()
        self.shared = shared
        self.own = dict(zip(words.tolist(), range(len(words)), strict=True))

    def __missing__(self, word: str) -> int:
        h = _hash(word)
        row = self.own.get(h)
        if row is None:  # not kept: rare words are many, and looked up faster than a large table
            return len(self.own) + h % self.shared
        self[word] = row
        return row


def row_ids(texts: Iterable[str], rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the words of texts in parts of bounded size, each with the number of its text.

    A long text may span parts; words are taken from it piece by piece.
    """
    ids, owners, n = [], [], 0
    for k, text in enumerate(texts):
        for part in pieces(_TOKENS, text):
            ids.append(np.fromiter(map(rows.__getitem__, part), np.int32, len(part)))
            owners.append(np.full(len(part), k, np.int32))
            n += len(part)
            if n >= _PART:
                yield np.concatenate(ids), np.concatenate(owners)
                ids, owners, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(owners)


def index_vectors(words: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every row's index vector, from the hash of its word or bucket."""
    rest = np.fromiter((_hash(f"\0{b}") for b in range(shared)), np.uint64, shared)
    h = np.concatenate([words.astype(np.uint64), rest])
    place = np.stack([(h >> np.uint64(16 * k)) % np.uint64(DIMS) for k in range(NONZERO)], axis=1).astype(np.int64)
    sign = np.stack([1 - 2 * (h >> np.uint64(63 - k) & np.uint64(1)).astype(np.int32) for k in range(NONZERO)], axis=1)
    return place, sign


def frequent_words(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the words that are one in ``SHARE`` of all tokens or more; all documents are counted."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = [pa.array(np.fromiter(map(_hash, held), np.uint64, len(held)).view(np.int64)), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["h", "n"])

        for batch in chain.from_iterable(map(slices, batches)):
            for text in strings(batch.column(0)):
                for part in pieces(_TOKENS, text):
                    held.update(part)
                if len(held) > COUNTED:
                    yield handed()
        yield handed()

    words = checkpoint(df.select(text_col).mapInArrow(counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    own = words.where(F.col("n") * SHARE >= total).select("h").toArrow().column(0).to_numpy()  # SHARE rows at most
    return np.sort(own.view(np.uint64))


class Vectors(NamedTuple):
    """Hashes of the words with a row of their own, and all rows: those, then the shared ones."""

    words: np.ndarray
    table: np.ndarray

    def rows(self) -> Rows:
        return Rows(self.words, len(self.table) - len(self.words))


def word_vectors(df: DataFrame, text_col: str = "text") -> Vectors:
    """Unit word vectors of all words, from all documents.

    Tasks sum their own tables; rows of sums are added up by partial aggregation.  The
    table has at most ``SHARE + BUCKETS`` rows of ``DIMS`` numbers whatever the data.
    """
    words = frequent_words(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(words)
    rest = BUCKETS
    size = len(words) + rest

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(shared.value, rest)
        total = np.zeros(size * DIMS, np.int32)
        texts = (t for batch in batches for part in slices(batch) for t in strings(part.column(0)))
        for ids, owners in row_ids(texts, Rows(shared.value, rest)):
            for reach in range(1, REACH + 1):
                near = np.flatnonzero(owners[:-reach] == owners[reach:])
                left, right = ids[near].astype(np.int64), ids[near + reach].astype(np.int64)
                for word, context in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        np.add.at(total, word * DIMS + place[context, k], sign[context, k])
        table = total.reshape(size, DIMS)
        used = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(used), 4096):
            at = used[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(table[at, d]) for d in range(DIMS)]], ["row", *[f"d{d}" for d in range(DIMS)]])

    schema = "row int, " + ", ".join(f"d{d} int" for d in range(DIMS))
    rows = df.select(text_col).mapInArrow(sums, schema).groupBy("row").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS)])
    table = np.zeros((size, DIMS), np.float32)
    for part in rows.toArrow().to_batches():
        table[part.column(0).to_numpy()] = np.stack([part.column(d + 1).to_numpy() for d in range(DIMS)], axis=1)
    return Vectors(words, table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9))


def pooled(texts: list[str], rows: Rows, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text and whether it has words; zeros without."""
    out, n = np.zeros((len(texts), DIMS)), np.zeros(len(texts), np.int64)
    for ids, owners in row_ids(texts, rows):
        starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        out[owners[starts]] += np.add.reduceat(vectors[ids], starts, axis=0)
        n += np.bincount(owners, minlength=len(texts))
    return np.concatenate([out / np.maximum(n, 1)[:, None], (n > 0)[:, None]], axis=1)


class Network(NamedTuple):
    """Weights of the two layers, scaling of the inputs, and the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit on pooled vectors and 0/1 labels.  Without rows the network says one half;
    with one label only it learns that label."""
    width = x.shape[1] if x.size else DIMS + 1
    rng = np.random.default_rng(5)
    p = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    if not len(x):
        return Network(np.zeros(width), np.ones(width), p[0], p[1], p[2], 0.0, 1.0)
    order = rng.permutation(len(x))
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4)
    held = len(x) // HELD
    tx, ty = (x[held:] - mean) / scale, y[held:]
    first, second = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    step = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(tx))
        for i in range(0, len(tx), BATCH):
            bx, by = tx[mixed[i : i + BATCH]], ty[mixed[i : i + BATCH]]
            h = np.tanh(bx @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - by) / len(by)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [bx.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
            step += 1
            for q, g, a, b in zip(p, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if held < 20:
        return net
    z, hy = net.logits(x[:held]), y[:held]
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - hy * z / t)
    return net._replace(temperature=float(min(np.geomspace(0.25, 8, 61), key=loss)))


class Classifier(NamedTuple):
    """What scoring needs: its size has a bound whatever the data (40 MB; 8 MB at 40,000 words)."""

    vectors: Vectors
    network: Network


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Word vectors over all of ``df``; a network over labelled rows outside the held-out fold.

    The held-out fold is crc32(id as text) mod 5 = 0.  Null ids, null labels and labels
    without a document teach nothing.  At most ``SAMPLE_ROWS`` distinct labels, in the
    order of a hash of their id, are fitted on; that is the bound of what is collected,
    as each takes one row: of several rows with its id, the one whose text has the
    smallest hash.
    """
    vectors = word_vectors(df, text_col)
    taught = labels.select(F.col(id_col).alias("taught"), F.col(label_col).cast("double").alias("label")).where("taught is not null and label is not null")
    taught = taught.where(F.crc32(F.col("taught").cast("string")) % 5 != 0).distinct().orderBy(F.xxhash64("taught"), "taught", "label").limit(SAMPLE_ROWS)
    shared = df.sparkSession.sparkContext.broadcast(vectors)

    def make():
        rows = shared.value.rows()
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(list(pooled(strings(b.column(2)), rows, shared.value.table)), pa.list_(pa.float64()))], ["id", "label", "h", "x"])

    given = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = given.join(F.broadcast(taught), F.col("id") == F.col("taught")).select(F.col("id").cast("string").alias("id"), "label", "text", F.xxhash64("text").alias("h"))
    one = map_batches(rows, make, "id string, label double, h bigint, x array<double>").groupBy("id", "label").agg(F.min(F.struct("h", "x")).alias("least"))
    found = one.select("id", "label", "least.x").toArrow().to_pydict()
    order = sorted(range(len(found["id"])), key=lambda i: (found["id"][i], found["label"][i], found["x"][i]))
    x = np.array([found["x"][i] for i in order]).reshape(len(order), DIMS + 1)
    return Classifier(vectors, fit(x, np.array([found["label"][i] for i in order])))


def score(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` of every row.

    Null and empty texts are scored as texts without tokens; a null id is not held out;
    repeated rows stay; an empty table gives an empty result; no other column is read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        vectors, network = shared.value
        rows = vectors.rows()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = network.probability(pooled(strings(batch.column(1)), rows, vectors.table))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [id_col, "score", "predicted"])

        return step

    scored = map_batches(df.select(id_col, text_col), make, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double, predicted int")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", "predicted")


def keep_good(df: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that the classifier does not reject, all columns as they were, whatever their names.

    Null and empty texts are judged as texts without words, all alike; repeated rows
    share their verdict; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        rows = vectors.rows()
        for batch in chain.from_iterable(map(slices, batches)):
            p = network.probability(pooled(strings(batch.column(names.index(text_col))), rows, vectors.table))
            yield batch.filter(pa.array(p >= THRESHOLD))

    return df.mapInArrow(run, df.schema)


