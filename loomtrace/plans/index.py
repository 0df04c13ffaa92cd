"""A stored passage index of immutable segments.

A commit writes one segment and a manifest, and never touches what is there:

* ``passages``, in the order of their keys within a file, each with a number; ``postings``
  of its new documents, a row a term and block of ``BLOCK`` neighbouring numbers;
* ``documents``, a log: the last row of a document counts, and names the segment that
  holds its passages (none once it is gone);
* ``deletes``: documents that an earlier segment holds no longer (its deletion vector);
* ``terms``, a log of passages and documents with each term, with negative rows for what
  was deleted, so that the figures of a collection need no look at its postings.

A manifest lists the segments with their sizes and the totals of the collection.  Its
file is created under the next version, which only one writer can do; a commit that
fails leaves files that no manifest names.  Segments of a like size are merged when there
are enough of them, so a passage is rewritten a logarithmic number of times.

Postings stay with their passages, so neither texts nor postings move: a file holds those
of neighbouring passages, sorted by term in runs of ``RUN`` passages, and the statistics of
its pages lead to a term.  A frequent term lies in all files.  A place is one number, of
the passage in its block and of the word in it; keys and lengths are read from the passages
that are met.  Each block carries the
impacts that no other one in it beats (occurrences and passage length), from which a bound
of its BM25 scores follows for whatever the collection has become; blocks of all terms
span the same passages, so bounds add up by block.  The best ``k`` passages are sought in
the blocks of the highest bounds first; what these give bounds which others are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import plain as P
from ..operators.canonical import create_new
from . import search
from .search import checkpoint

#: Passages that a block spans, segments of a level before they are merged, bytes of a file, and rows that are handed to every task.
BLOCK, FAN, FILE_BYTES, SMALL = 16, 4, 128 << 20, 100_000
#: Passages of a sorted run of postings, words of a passage that a place can tell, and bytes of text a task below which rows move into fewer files.
RUN, WORDS, LEAST_BYTES = 8192, 1 << 27, 4 << 20
KEYS = ["document_id", "entry_id", "passage_no"]
DOCUMENT = "document_id string, source string, native_session_id string, source_path string, canonical_hash string, holder string, n_passages bigint, n_tokens bigint, version bigint"
PASSAGE = "passage bigint, document_id string, entry_id string, passage_no bigint, parent_entry_id string, role string, provenance string, timestamp string, text string, n_tokens int"
POSTING = "term string, block bigint, n int, impacts array<struct<f:int,n:int>>, places array<int>, documents array<struct<document_id:string,n:int>>"
TERM = "term string, n_passages bigint, n_documents bigint"
DELETE = "holder string, document_id string"
TABLES = {"documents": DOCUMENT, "passages": PASSAGE, "postings": POSTING, "terms": TERM, "deletes": DELETE}


class Conflict(RuntimeError):
    """Another writer made the version that this one wanted to make."""


class Segment(NamedTuple):
    """What a manifest says of a segment; ``size`` is the number of rows it was written with."""

    name: str
    version: int
    size: int


class Index(NamedTuple):
    """One version of an index: its segments, the totals of its live passages, and where merged segments went."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: tuple[Segment, ...] = ()
    passages: int = 0
    tokens: int = 0
    merged: tuple[tuple[str, str, int], ...] = ()

    def table(self, name: str, segments: tuple[str, ...] | None = None) -> DataFrame:
        """A table over the given segments (all, if none are given), with the column ``segment``."""
        names = [s.name for s in self.segments] if segments is None else list(segments)
        schema = f"{TABLES[name]}, segment string"
        if not names:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/segment={s}" for s in names])

    def documents(self, only: DataFrame | None = None) -> DataFrame:
        """Live documents (``only`` some, where given) with the segment that holds them now; a partial aggregate over the log."""
        rows = self.table("documents").drop("segment")
        if only is not None:
            rows = rows.join(only.select("document_id").distinct(), "document_id", "left_semi")
        return _last(rows).where("holder is not null").withColumn("holder", self.now("holder"))

    def now(self, holder: str) -> Column:
        """The present name of a segment that may have been merged since."""
        pairs = [F.lit(x) for a, b, _ in self.merged for x in (a, b)]
        return F.coalesce(F.create_map(*pairs)[F.col(holder)], F.col(holder)) if pairs else F.col(holder)

    def live(self, rows: DataFrame, segments: tuple[str, ...] | None = None) -> DataFrame:
        """Passages or entries (with ``segment`` and ``document_id``) without deleted documents.

        A deletion names a segment as it was called then.  If that was merged since, it
        has been carried out, and the document may stand in the merged one by a later commit.
        """
        gone = self.table("deletes").select(F.col("holder").alias("segment"), "document_id")
        gone = gone.where(F.col("segment").isin([s.name for s in self.segments] if segments is None else list(segments)))
        return rows.join(_few(gone.distinct()), ["segment", "document_id"], "left_anti")


def _few(keys: DataFrame) -> DataFrame:
    """Keys to be handed to every task while they are few, so that what they are joined with stays where it is."""
    return F.broadcast(keys) if keys.limit(SMALL + 1).count() <= SMALL else keys


def _last(log: DataFrame) -> DataFrame:
    """The last row of each document."""
    rest = F.struct(*[c for c in log.columns if c != "document_id"])
    return log.groupBy("document_id").agg(F.max_by(rest, "version").alias("r")).select("document_id", "r.*")


# -- manifests


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _list(spark: SparkSession, path: str) -> list[str]:
    fs, place = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def read(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The last version of an index, or a given one; a folder without a manifest is an empty index."""
    names = [n for n in _list(spark, f"{path}/manifest") if n.endswith(".json")]
    if version is not None:
        names = [n for n in names if int(n[:-5]) == version]
    if not names:
        return Index(spark, path)
    found = json.loads(spark.read.text(f"{path}/manifest/{names[-1]}", wholetext=True).first()[0])
    return Index(spark, path, found["version"], tuple(Segment(*s) for s in found["segments"]), found["passages"], found["tokens"], tuple(map(tuple, found["merged"])))


def _publish(index: Index) -> Index:
    """Make a version visible, if nobody has made it before: the file is written aside and moved without overwriting."""
    spark, body = index.spark, json.dumps({"version": index.version, "segments": index.segments, "passages": index.passages, "tokens": index.tokens, "merged": index.merged})
    if not create_new(spark, f"{index.path}/manifest/{index.version:012d}.json", body):
        raise Conflict(f"version {index.version} of {index.path} exists")
    return index


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove manifests but the last ``keep`` and the segments that none of these names; the names of what went.

    Not to be run beside a writer: a segment that is being written has no manifest yet.
    """
    names = [n for n in _list(spark, f"{path}/manifest") if n.endswith(".json")]
    stay = {s.name for n in names[-keep:] for s in read(spark, path, int(n[:-5])).segments}
    gone = [f"manifest/{n}" for n in names[:-keep]]
    gone += [f"{t}/{n}" for t in TABLES for n in _list(spark, f"{path}/{t}") if n.partition("=")[2] not in stay]
    for name in gone:
        fs, place = _fs(spark, f"{path}/{name}")
        fs.delete(place, True)
    return gone


# -- writing


def said(turns: DataFrame) -> DataFrame:
    """What users and assistants say: the turns that are indexed.  A turn without an entry has the empty one."""
    rows = turns.where(F.col("role").isin("user", "assistant"))
    return rows.select("document_id", F.coalesce("entry_id", F.lit("")).alias("entry_id"), "parent_entry_id", "role", F.coalesce("provenance", F.lit("original")).alias("provenance"), "timestamp", "content")


def _passages(turns: DataFrame) -> DataFrame:
    """Passages of turns as :func:`said` gives them; within a row, so nothing moves."""
    keys = ["document_id", "entry_id", "parent_entry_id", "role", "provenance", "timestamp"]
    found = search.passages(turns, keys).withColumn("passage_no", F.col("passage_no").cast("bigint"))
    return found.select(*KEYS, *keys[2:], "text", search.token_count(F.col("text")).alias("n_tokens"))


def postings(passages: DataFrame) -> DataFrame:
    """``POSTING`` rows of numbered passages, a run at a time: the blocks of neighbours never move.

    A block that two tasks share has a row in each.  ``places`` are ``WORDS`` times the
    passage in the block, and the word in the passage.  The first row that a term has in a
    run tells how many passages of each document hold it there; in the others that is null.
    """
    given = passages.select("passage", "document_id", search.tokens(F.col("text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                if len(part.column(2).flatten()):
                    yield from _block_rows(part)

    return given.mapInArrow(run, POSTING)


def _block_rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Blocks of a run: sorted by term, block, passage and place, and cut where these change."""
    sizes = np.diff(part.column(2).offsets.to_numpy())
    if sizes.max() > WORDS:
        raise ValueError(f"a passage of more than {WORDS} words")
    row = np.repeat(np.arange(part.num_rows, dtype=np.int32), sizes)
    words = part.column(2).flatten().dictionary_encode()
    rank = np.empty(len(words.dictionary), np.int32)
    by_name = pc.array_sort_indices(words.dictionary)
    rank[by_name.to_numpy()] = np.arange(len(rank), dtype=np.int32)
    term, passage = rank[words.indices.to_numpy()], part.column(0).to_numpy()
    named = passage[1:] < passage[:-1]
    if named.any():  # numbers that are no order: blocks of one task still are in order
        by_number = np.argsort(passage, kind="stable")
        place_of = np.empty_like(by_number)
        place_of[by_number] = np.arange(len(by_number))
        order = np.lexsort((place_of[row], term))
    else:
        order = np.argsort(term, kind="stable")
    place = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]
    term, row = term[order], row[order]
    block, inside = passage[row] // BLOCK, (passage[row] % BLOCK).astype(np.int32)
    new_term = np.append(True, term[1:] != term[:-1])
    new_block = new_term | np.append(True, block[1:] != block[:-1])
    new_entry = new_block | np.append(True, row[1:] != row[:-1])
    entry_at, block_at = np.flatnonzero(new_entry), np.flatnonzero(new_block)
    f = np.diff(np.append(entry_at, len(row))).astype(np.int32)
    of = row[entry_at]
    offsets = np.append(np.searchsorted(entry_at, block_at), len(entry_at)).astype(np.int32)
    best, counts = _impacts(f, sizes[of], offsets)
    impacts = _lists(counts, pa.StructArray.from_arrays([pa.array(best[:, 0]), pa.array(best[:, 1])], ["f", "n"]))
    places = _lists(np.diff(np.append(block_at, len(row))), pa.array(inside * np.int32(WORDS) + place))
    # passages of a document with each term, at the term's first block
    ids = part.column(1).dictionary_encode(null_encoding="encode")
    pairs, held = np.unique(term[entry_at].astype(np.int64) * len(ids.dictionary) + ids.indices.to_numpy()[of], return_counts=True)
    first = new_term[block_at]
    per_term = np.zeros(len(block_at), np.int64)
    per_term[first] = np.bincount(pairs // len(ids.dictionary), minlength=len(rank))[term[block_at[first]]]
    documents = pa.StructArray.from_arrays([ids.dictionary.take(pa.array(pairs % len(ids.dictionary))), pa.array(held.astype(np.int32))], ["document_id", "n"])
    documents = _lists(per_term, documents, ~first)
    names = words.dictionary.take(by_name).take(pa.array(term[block_at]))
    rows = pa.RecordBatch.from_arrays([names, pa.array(block[block_at]), pa.array(np.diff(offsets)), impacts, places, documents], ["term", "block", "n", "impacts", "places", "documents"])
    for at in range(0, rows.num_rows, 32 * RUN):
        yield rows.slice(at, 32 * RUN)


def _lists(sizes: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.ListArray:
    """Lists of given sizes over consecutive values."""
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=None if null is None else pa.array(null))


def _impacts(f: np.ndarray, n: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block the (occurrences, length) that no other has at more occurrences and less length."""
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((n, -f, block))
    block, f, n = block[order], f[order], n[order].astype(np.int32)
    # the least length so far in its block; blocks after one another fall below all before
    low = n.astype(np.int64) - block * (int(n.max(initial=0)) + 1)
    keep = np.append(True, low[1:] < np.minimum.accumulate(low)[:-1])
    return np.stack([f[keep], n[keep]], axis=1), np.bincount(block[keep], minlength=len(offsets) - 1)


def _files(spark: SparkSession, rows: int, bytes_: int) -> int:
    """Files of bounded bytes; more of them where cores would idle, but none of less than a thousand rows."""
    return max(1, -(-bytes_ // FILE_BYTES), min(spark.sparkContext.defaultParallelism, rows // 1000))


def _write_passages(index: Index, name: str, rows: DataFrame, text: str, make: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
    """Store the passages that ``make`` gives of rows, numbered in the order of their keys in a file, and their postings; how many passages and tokens.

    Rows stay in their tasks, so a text is never written but in its passages, unless they are so few that files would be small.
    """
    each = rows.select(F.octet_length(text).alias("size"), F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    n, size, parts = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    place = lambda table: f"{index.path}/{table}/segment={name}"
    files = _files(index.spark, n, size)
    if parts > files and size < parts * LEAST_BYTES:
        rows = rows.repartitionByRange(files, "document_id", "entry_id")
    ordered = make(rows).sortWithinPartitions(*KEYS)
    _store(ordered.select(F.monotonically_increasing_id().alias("passage"), *KEYS, "parent_entry_id", "role", "provenance", "timestamp", "text", "n_tokens"), place("passages"))
    stored = index.spark.read.schema(PASSAGE).parquet(place("passages"))
    _store(postings(stored), place("postings"))
    return tuple(stored.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first())


def _store(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "zstd").parquet(path)


def _term_counts(rows: DataFrame) -> DataFrame:
    """Passages and documents with each term, of ``rows(term, document_id, n)``."""
    each = rows.groupBy("term", "document_id").agg(F.sum("n").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n_passages"), F.count("*").alias("n_documents"))


def _terms_of(passages: DataFrame) -> DataFrame:
    """Terms of stored passages: term, document, passages."""
    found = passages.select("segment", "document_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    return found.groupBy("segment", "term", "document_id").agg(F.count("*").alias("n"))


def _write_logs(index: Index, name: str, documents: DataFrame, terms: DataFrame, deletes: DataFrame) -> None:
    for table, rows, order in (("documents", documents, "document_id"), ("terms", terms, "term"), ("deletes", deletes, "holder")):
        columns = [c.split()[0] for c in TABLES[table].split(", ")]
        _store(rows.select(*columns).sortWithinPartitions(order), f"{index.path}/{table}/segment={name}")


def _name(version: int) -> str:
    return f"{version:012d}-{uuid.uuid4().hex[:8]}"


def _made(name: str) -> int:
    """The version that a segment was written for."""
    return int(name.partition("-")[0])


def commit(index: Index, changed: DataFrame, turns: DataFrame, kept: DataFrame | None = None, gone: DataFrame | None = None) -> Index:
    """The next version: ``changed`` documents replaced whole, ``kept`` ones with a new path, ``gone`` ones deleted.

    ``changed(document_id, source, native_session_id, source_path, canonical_hash)``,
    ``kept(document_id, source_path)``, ``gone(document_id)``; one row a document.  What
    is written grows with these, not with the index.
    """
    spark, version = index.spark, index.version + 1
    name = _name(version)
    changed = checkpoint(changed.select("document_id", "source", "native_session_id", C.redact(F.col("source_path")).alias("source_path"), "canonical_hash"))
    n, tokens = _write_passages(index, name, said(turns.join(_few(changed.select("document_id")), "document_id", "left_semi")), "content", _passages)
    new = index._replace(version=version, segments=(*index.segments, Segment(name, version, n)))
    count = new.table("passages", (name,)).groupBy("document_id").agg(F.count("*").alias("n_passages"), F.sum("n_tokens").alias("n_tokens"))
    zero = F.lit(0).cast("bigint")
    rows = changed.join(count, "document_id", "left").select("document_id", "source", "native_session_id", "source_path", "canonical_hash", F.lit(name).alias("holder"), F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("n_tokens", zero).alias("n_tokens"), F.lit(version).cast("bigint").alias("version"))
    leave = changed.select("document_id") if gone is None else changed.select("document_id").unionByName(gone.select("document_id"))
    had = checkpoint(index.documents(leave))
    if gone is not None:
        none = had.join(gone.select("document_id").distinct(), "document_id", "left_semi")
        rows = rows.unionByName(none.select("document_id", "source", "native_session_id", "source_path", "canonical_hash", F.lit(None).cast("string").alias("holder"), zero.alias("n_passages"), zero.alias("n_tokens"), F.lit(version).cast("bigint").alias("version")))
    if kept is not None:
        path = kept.select("document_id", C.redact(F.col("source_path")).alias("_path"))
        moved = index.documents(path).join(path, "document_id").where(~F.col("source_path").eqNullSafe(F.col("_path")))
        rows = rows.unionByName(moved.withColumn("source_path", F.col("_path")).withColumn("version", F.lit(version).cast("bigint")).select(rows.columns))
    # what leaves takes its terms along: its passages alone are read again
    deletes = had.where("n_passages > 0").select("holder", "document_id")
    holders = tuple(r[0] for r in deletes.select("holder").distinct().collect())  # segments, a few
    lost = _terms_of(index.table("passages", holders).join(_few(deletes.withColumnRenamed("holder", "segment")), ["segment", "document_id"], "left_semi"))
    found = _term_counts(new.table("postings", (name,)).where("documents is not null").select("term", F.explode("documents").alias("d")).select("term", "d.document_id", "d.n"))
    less = _term_counts(lost).select("term", (-F.col("n_passages")).alias("n_passages"), (-F.col("n_documents")).alias("n_documents"))
    terms = found.unionByName(less).groupBy("term").agg(F.sum("n_passages").alias("n_passages"), F.sum("n_documents").alias("n_documents"))
    _write_logs(index, name, rows, terms, deletes)
    left = had.agg(F.coalesce(F.sum("n_passages"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return _publish(new._replace(passages=index.passages + n - left[0], tokens=index.tokens + tokens - left[1]))


def update(index: Index, sessions: DataFrame, turns: DataFrame, force: bool = False, fan: int = FAN) -> Index:
    """The index with sessions upserted: those of :func:`commit` with ``classification`` and ``status``.

    Only primary sessions are taken; an empty one leaves the index; one whose hash is
    indexed already only brings its path up to date, unless ``force``; any other is
    replaced whole.  Segments are merged where ``fan`` of a level have come together.
    """
    primary = sessions.where("classification = 'primary'")
    gone = primary.where("status = 'empty_after_normalization'").select("document_id")
    rest = primary.where("status is null or status <> 'empty_after_normalization'")
    known = index.documents(rest).select("document_id", F.col("canonical_hash").alias("_known"))
    rest = checkpoint(rest.join(known, "document_id", "left"))
    same = F.coalesce(F.col("_known") == F.col("canonical_hash"), F.lit(False)) & F.lit(not force)
    new = commit(index, rest.where(~same), turns, rest.where(same), gone)
    while len(group := due(new, fan)) > 1:
        new = merge(new, group)
    return new


def remove(index: Index, gone: DataFrame) -> Index:
    """The index without some documents."""
    none = index.spark.createDataFrame([], "document_id string, source string, native_session_id string, source_path string, canonical_hash string")
    turns = index.spark.createDataFrame([], "document_id string, entry_id string, parent_entry_id string, role string, provenance string, timestamp string, content string")
    return commit(index, none, turns, gone=gone)


def due(index: Index, fan: int = FAN) -> tuple[str, ...]:
    """Segments to merge: the first ``fan`` of a level, the lowest first.  A level holds ``fan`` times the one below."""
    levels: dict[int, list[str]] = {}
    for s in index.segments:
        level, size = 0, 1000
        while s.size > size:
            level, size = level + 1, size * fan
        levels.setdefault(level, []).append(s.name)
    for _, names in sorted(levels.items()):
        if len(names) >= fan:
            return tuple(names[:fan])
    return ()


def merge(index: Index, names: tuple[str, ...]) -> Index:
    """The next version, with some segments as one: deleted passages gone, logs reduced to what still says something."""
    version = index.version + 1
    name = _name(version)
    live = index.live(index.table("passages", names), names)
    n, _ = _write_passages(index, name, live.drop("segment", "passage"), "text", lambda rows: rows)
    last = _last(index.table("documents", names).drop("segment"))
    rest = tuple(s for s in index.segments if s.name not in names)
    if not rest or min(s.version for s in rest) > max(s.version for s in index.segments if s.name in names):
        last = last.where("holder is not null")  # nothing older is left that it would hide
    holder = F.when(index.now("holder").isin(list(names)), F.lit(name)).otherwise(index.now("holder"))
    documents = last.withColumn("holder", holder)
    terms = index.table("terms", names).groupBy("term").agg(F.sum("n_passages").alias("n_passages"), F.sum("n_documents").alias("n_documents")).where("n_passages <> 0 or n_documents <> 0")
    deletes = index.table("deletes", names).where(F.col("holder").isin([s.name for s in rest])).distinct()
    _write_logs(index, name, documents, terms, deletes)
    segments = tuple(sorted((*rest, Segment(name, max(s.version for s in index.segments if s.name in names), n)), key=lambda s: s.version))
    merged = [(a, name if b in names else b, v) for a, b, v in index.merged] + [(x, name, version) for x in names]
    # a log names segments that were there when it was written
    merged = tuple((a, b, v) for a, b, v in merged if any(_made(a) <= _made(s.name) < v for s in segments))
    return _publish(index._replace(version=version, segments=segments, merged=merged))


# -- searching


def _read(index: Index, terms: list[str]) -> DataFrame:
    return index.table("postings").where(F.col("term").isin(terms))


def _met(rows: DataFrame) -> DataFrame:
    """``segment``, ``passage``, ``term``, ``positions`` of blocks: a passage's places of a term are all in one row."""
    slot = lambda p: F.shiftright(p, 27)
    each = rows.select("segment", "term", "block", "places", F.explode(F.array_distinct(F.transform("places", slot))).alias("s"))
    positions = F.transform(F.filter("places", lambda p: slot(p) == F.col("s")), lambda p: p.bitwiseAND(F.lit(WORDS - 1)))
    return each.select("segment", (F.col("block") * BLOCK + F.col("s")).alias("passage"), "term", positions.alias("positions"))


def _entries(index: Index, rows: DataFrame) -> DataFrame:
    """Live entries of blocks: one row a term and passage."""
    return _known(index, _met(rows))


def _known(index: Index, rows: DataFrame) -> DataFrame:
    """``rows(segment, passage)`` of live passages, with their keys, times and lengths."""
    return index.live(rows.join(index.table("passages").select("segment", "passage", *KEYS, "timestamp", "n_tokens"), ["segment", "passage"]))


def counted(index: Index, phrases: list[list[str]]) -> DataFrame:
    """Passages that hold some phrase, as :func:`search.counted` has them, from the postings of their terms alone."""
    terms = sorted({t for p in phrases for t in p})
    each = _met(_read(index, terms)).groupBy("segment", "passage").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

    def count(p: list[str]) -> Column:
        places = [F.coalesce(F.try_element_at(F.col("at"), F.lit(t)), F.array().cast("array<int>")) for t in p]
        first = places[0]
        for k, later in enumerate(places[1:], 1):
            first = F.array_intersect(first, _shifted(later, k))
        return F.size(first)

    counts = [f"_f{k}" for k in range(len(phrases))]
    out = each.select("segment", "passage", *[count(p).alias(c) for c, p in zip(counts, phrases, strict=True)])
    out = _known(index, out.where(F.greatest(*map(F.col, counts), F.lit(0)) > 0))
    return checkpoint(out.select(*KEYS, "timestamp", F.col("n_tokens").alias("_n"), *counts))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def frequencies(index: Index, terms: list[str]) -> dict[str, tuple[int, int]]:
    """Live passages and documents with each term, from the log of terms."""
    rows = index.table("terms").where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n_passages").alias("p"), F.sum("n_documents").alias("d")).collect()  # a row a term asked for
    return {t: next(((r.p, r.d) for r in rows if r.term == t), (0, 0)) for t in terms}


def passages_with(index: Index) -> DataFrame:
    """``term``, ``n_entries``: live passages with each term, counted in the postings; only blocks that hold a deleted passage are looked into."""
    gone = index.table("deletes").select(F.col("holder").alias("segment"), "document_id").distinct()
    dead = index.table("passages").select("segment", "document_id", "passage").join(_few(gone), ["segment", "document_id"], "left_semi")
    dead = dead.groupBy("segment", F.floor(F.col("passage") / BLOCK).alias("block")).agg(F.collect_list(F.pmod("passage", F.lit(BLOCK)).cast("int")).alias("dead"))
    left = F.size(F.array_except(F.transform("places", lambda p: F.shiftright(p, 27)), "dead"))
    rows = index.table("postings").select("segment", "term", "block", "n", "places").join(dead, ["segment", "block"], "left")
    return rows.groupBy("term").agg(F.sum(F.when(F.col("dead").isNull(), F.col("n")).otherwise(left)).alias("n_entries")).where("n_entries > 0")


class Found(NamedTuple):
    """The best passages, and how many entries of how many were read for them."""

    hits: DataFrame
    entries_read: int
    entries: int


def best(index: Index, terms: list[str], k: int = search.CANDIDATES) -> Found:
    """``document_id``, ``entry_id``, ``passage_no``, ``timestamp``, ``rank`` of the ``k`` best passages for single terms (BM25, more negative is better).

    Ties go by key.  The blocks of the highest bounds are read first; the ``k``-th score
    in them bounds what can still enter, and of the others only blocks that reach it are
    read.  Every passage of a block that is read is scored with all its terms, so the
    result is exact.  A repeated term counts once each time it is given.
    """
    known = frequencies(index, sorted(set(terms)))
    mean = index.tokens / max(index.passages, 1)
    norm = lambda n: search.K1 * (1 - search.B + search.B * n / max(mean, 1e-9))
    figures = search.Statistics(index.passages, mean, [known[t][0] for t in terms], [known[t][1] for t in terms])
    weight = {t: terms.count(t) * search.idf(index.passages, p) * (search.K1 + 1) for t, (p, _) in known.items()}
    of = F.create_map(*[F.lit(x) for t in weight.items() for x in t])[F.col("term")]
    rows = _read(index, sorted(weight))
    # a block that two tasks wrote has two rows a term: their bounds add up, which is a bound as well
    bounds = rows.select("segment", "block", "n", (of * F.array_max(F.transform("impacts", lambda x: x["f"] / (x["f"] + norm(x["n"]))))).alias("bound"))
    bounds = checkpoint(bounds.groupBy("segment", "block").agg(F.sum("n").alias("n"), F.sum("bound").alias("bound")))

    def scored(blocks: DataFrame) -> DataFrame:
        few = blocks.select("segment", "block").limit(SMALL + 1).collect()
        read_ = rows
        if len(few) <= SMALL:  # literals reach the scan
            read_ = rows.where(F.col("block").isin(sorted({r.block for r in few})) & F.col("segment").isin(sorted({r.segment for r in few})))
            blocks = F.broadcast(blocks)
        read_ = read_.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        count = lambda t: F.coalesce(F.max(F.when(F.col("term") == t, F.size("positions"))), F.lit(0))
        part = _known(index, _met(read_).groupBy("segment", "passage").agg(*[count(t).alias(f"_f{i}") for i, t in enumerate(terms)]))
        return search.ranked(part.withColumnRenamed("n_tokens", "_n"), figures).select(*KEYS, "timestamp", "rank")

    order = ["rank", *KEYS]
    seeds = checkpoint(bounds.orderBy(F.desc("bound"), "segment", "block").limit(k))  # of one term: their best passages alone are k
    top = checkpoint(scored(seeds).orderBy(*order).limit(k))
    least = top.agg(F.count("*"), F.max("rank")).first()
    floor = -least[1] * (1 - 1e-9) if least[0] == k else float("-inf")
    others = checkpoint(bounds.where(F.col("bound") >= floor).join(F.broadcast(seeds.select("segment", "block")), ["segment", "block"], "left_anti"))
    found = checkpoint(top.unionByName(scored(others)).orderBy(*order).limit(k))
    read_, every = seeds.unionByName(others).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Found(found, read_, every)


def evidence(index: Index, query: str) -> DataFrame:
    """Hits of a query as :func:`search.evidence` has them, with the source path of their document.

    Only user and assistant turns of primary sessions are in an index.
    """
    phrases = [p for t in P.query_terms(query) if (p := search.phrase(t))]
    passages = index.table("passages")
    columns = [c for c in passages.columns if c not in ("passage", "n_tokens", "segment")]
    if not phrases:
        found = passages.limit(0).withColumn("bucket", F.lit(0)).withColumn("rank", F.lit(0.0)).select(*columns, "bucket", "rank")
    else:
        hits = counted(index, phrases)
        known = search.statistics(hits, phrases, "document_id", (index.passages, index.tokens))
        texts = lambda keys: search.texts_of(index.live(passages), keys).select(columns)
        found = search.select_hits(hits, known, query, texts, columns)
    found = checkpoint(found)  # at most six rows
    log = index.table("documents").where(F.col("document_id").isin([r[0] for r in found.select("document_id").distinct().collect()]))
    paths = log.groupBy("document_id").agg(F.max_by("source_path", "version").alias("source_path"))
    return found.join(paths, "document_id")
