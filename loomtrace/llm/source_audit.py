"""How the sources of a language differ in their words, with deduplicated count columns.

A term of a language is a column of counts, one a source, most of them zero.  Terms with
the same sparse column (the same counts in the same sources) say the same about every
pair of sources, so terms are grouped by column and a pair is evaluated once a distinct
column and multiplied by how many terms have it.  Zeros are never spelled out: with
``f(a, b)`` the divergence of counts ``a`` and ``b``, the sum over all ``V`` terms is

    V f(0,0)  +  sum over a > 0 of f(a,0) - f(0,0)  +  sum over b > 0 of f(0,b) - f(0,0)
              +  sum over a, b > 0 of f(a,b) - f(a,0) - f(0,b) + f(0,0)

where only the last sum looks at pairs inside a column, and only at its sources.  The
other two need how often a source has each count, no more.  Ranks of terms come from the
terms themselves.

All arithmetic is on integers: a probability is in billionths, and sums of divergences
keep below 2^62 as long as a language has fewer than a billion kept terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, BROADCAST_LIMIT, blank_pieces, blobs, checkpoint, slices

#: Documents of a language that a kept term stands in at least, and the last rank of a term.
LEAST_DOCUMENTS, LAST_RANK = 3, 200
#: A probability of one.
UNIT = 1_000_000_000
#: Terms that a task counts, and pairs of sources that it sums, before it hands them on.
HELD_TERMS, HELD_PAIRS = 300_000, 200_000
#: Pairs of a column that are evaluated at a time.
BLOCK = 1 << 19

#: Bytes of a text that are no part of a term become blanks, A-Z become a-z.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in ASCII_LOWER)


def counted_terms(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``term``, ``source``, ``n`` occurrences, ``docs`` documents with it; several rows a key, to be added up.

    A row is a document; null values read as empty strings.
    """
    given = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c_) for c, c_ in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for part in (p for batch in batches for p in slices(batch)):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), blobs(part.column(2)), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in blank_pieces(text.translate(_TERMS)):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from flushed(held)
                    held, size = {}, 0
        yield from flushed(held)

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), terms, pa.array([source] * size, pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "term", "source", "n", "docs"])

    return given.mapInArrow(run, "lang string, term string, source string, n bigint, docs bigint")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang``, ``term`` and its sparse column ``counts``, an array of (``source``, ``n``) by source, of terms in enough documents."""
    each = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    column = F.array_sort(F.collect_list(F.struct("source", "n")))
    return each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), column.alias("counts")).where(F.col("docs") >= least).drop("docs")


def probability(count: Column, total: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / total)``, in three steps of a thousand each, so that nothing overflows a long.

    A total of nothing (a language without kept terms) counts as one; nothing is summed there.
    """
    total = F.greatest(total, F.lit(1).cast("bigint"))
    left, whole = count + F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    step = F.struct(left.alias("left"), whole.alias("whole"))
    for _ in range(3):
        step = _bound(step, lambda s: F.struct(_mod(s["left"] * 1000, total).alias("left"), (s["whole"] * 1000 + _div(s["left"] * 1000, total)).alias("whole")))
    return _bound(step, lambda s: s["whole"] + 1)


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _mod(a: Column, b: Column) -> Column:
    return F.call_function("mod", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _probabilities(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    left, whole = counts + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        left = left * 1000
        whole = whole * 1000 + left // totals
        left %= totals
    return whole + 1


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def column_pairs(columns: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``other``, ``value``: partial sums of the correction where both counts are above zero.

    ``columns(lang, counts, totals, n)`` are distinct columns, the totals of their
    sources and their numbers of terms.  A pair is evaluated once a column, in blocks of
    bounded size; a task holds bounded sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], int] = {}
        names: dict[str, int] = {}
        for part in (p for batch in batches for p in slices(batch)):
            for lang, a, b, values in _blocks(part, names):
                keys, at = np.unique(a << 32 | b, return_inverse=True)
                totals = np.zeros(len(keys), np.int64)
                np.add.at(totals, at, values)
                for key, value in zip(keys.tolist(), totals.tolist(), strict=True):
                    k = lang, key >> 32, key & 0xFFFFFFFF
                    sums[k] = sums.get(k, 0) + value
                if len(sums) > HELD_PAIRS:
                    yield _pairs(sums, names)
                    sums = {}
        yield _pairs(sums, names)

    return columns.select("lang", "counts.source", "counts.n", "totals", F.col("n").alias("m")).toDF("lang", "sources", "counts", "totals", "m").mapInArrow(run, "lang string, source string, other string, value bigint")


def _blocks(part: pa.RecordBatch, names: dict[str, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Weighted corrections of all ordered pairs inside the columns of a batch: language, two numbers of sources, values."""
    lang, m = np.array(part.column(0).to_pylist(), object), part.column(4).to_numpy()
    sizes = np.diff(part.column(1).offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.array([names.setdefault(s, len(names)) for s in part.column(1).flatten().to_pylist()], np.int64)
    counts, totals = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
    p, zero = _probabilities(counts, totals), _probabilities(np.zeros_like(counts), totals)
    for language in sorted(set(lang.tolist())):
        # every entry of a column meets all entries of that column
        rows = np.flatnonzero(lang == language)
        entries = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows] or [np.zeros(0, np.int64)])
        column = np.repeat(rows, sizes[rows])
        fan = sizes[column]
        edges, at = np.cumsum(fan), 0
        while at < len(entries):
            end = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + BLOCK, "right")))
            for lo, hi in _spans(fan[at:end]):
                n = hi - lo
                mine = np.repeat(np.arange(at, end), n)
                a, b = entries[mine], starts[column[mine]] + np.repeat(lo, n) + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
                mine, a, b = (x[a != b] for x in (mine, a, b))
                value = _divergences(p[a], p[b]) - _divergences(p[a], zero[b]) - _divergences(zero[a], p[b]) + _divergences(zero[a], zero[b])
                yield language, ids[a], ids[b], value * m[column[mine]]
            at = end


def _spans(fan: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges of partners a block: all at once, or, for one entry with more than a block, in turns."""
    if len(fan) > 1 or fan[0] <= BLOCK:
        yield np.zeros_like(fan), fan
        return
    for lo in range(0, int(fan[0]), BLOCK):
        yield np.array([lo]), np.array([min(lo + BLOCK, int(fan[0]))])


def _pairs(sums: dict, names: dict[str, int]) -> pa.RecordBatch:
    called = list(names)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in sums], pa.string()), pa.array([called[k[1]] for k in sums], pa.string()), pa.array([called[k[2]] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "source", "other", "value"]
    )


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, last_rank: int = LAST_RANK) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair, term), ``item``, ``value``, ``rank``.

    ``pair``: every other source of the language and the divergence from it, summed over
    all kept terms (0 where none is kept).  ``term``: terms of the source that stand out
    from the language, up to ``last_rank``.  Ranks go by value, falling, then by item.

    Null texts, languages and sources read as empty strings; a row is a document, also
    one that repeats another; a group without any term takes part in pairs; a language of
    one source has none; an empty table gives no rows; further columns are not read.
    """
    given = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    terms = checkpoint(kept_terms(counted_terms(given), least))
    groups = given.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()

    # columns: terms with equal counts, and how many they are
    columns = terms.groupBy("lang", "counts").agg(F.count("*").alias("n"))
    columns = checkpoint(columns.withColumn("id", F.monotonically_increasing_id()))
    sizes = columns.groupBy("lang").agg(F.sum("n").alias("v"), F.sum(F.col("n") * F.aggregate("counts.n", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("lang_tokens"))
    had = columns.select("lang", F.explode("counts").alias("c"), "n").groupBy("lang", "c.source", F.col("c.n").alias("count")).agg(F.sum("n").alias("m"))
    had = checkpoint(had)  # how often a source has each count
    tokens = had.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("m")).alias("tokens"))
    none = F.lit(0).cast("bigint")
    known = groups.join(tokens, ["lang", "source"], "left").join(sizes, "lang", "left")
    known = checkpoint(known.select("lang", "source", F.coalesce("tokens", none).alias("tokens"), F.coalesce("v", none).alias("v"), F.coalesce("lang_tokens", none).alias("lang_tokens")))
    # text of a name, numbers and what the JVM adds: well below 512 bytes a group, names of any length apart
    fits = known.agg(F.coalesce(F.sum(F.lit(512) + F.octet_length("lang") + F.octet_length("source")), F.lit(0))).first()[0] <= BROADCAST_LIMIT

    totals = known.select("lang", "source", (F.col("tokens") + F.col("v")).alias("total"), "v")
    return _pair_part(columns, had, totals, fits).unionByName(_term_part(terms, known, fits, last_rank))


def _small(table: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(table) if fits else table


def _pair_part(columns: DataFrame, had: DataFrame, totals: DataFrame, fits: bool) -> DataFrame:
    others = totals.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"))
    zero = F.lit(0).cast("bigint")
    p0, q0 = probability(zero, F.col("total")), probability(zero, F.col("other_total"))
    # the output itself is a row for each pair of sources of a language
    pairs = totals.join(_small(others, fits), "lang").where("source <> other")
    base = pairs.select("lang", "source", "other", F.when(F.col("v") > 0, F.col("v") * divergence(p0, q0)).otherwise(zero).alias("value"))

    counts = had.join(_small(totals, fits), ["lang", "source"]).withColumn("p", probability(F.col("count"), F.col("total"))).withColumn("p0", p0)
    meets = counts.join(_small(others.withColumn("q0", q0), fits), "lang").where("source <> other")
    alone = divergence(F.col("p0"), F.col("q0"))
    first = F.col("m") * (divergence(F.col("p"), F.col("q0")) - alone)
    second = F.col("m") * (divergence(F.col("q0"), F.col("p")) - divergence(F.col("q0"), F.col("p0")))
    one_sided = meets.groupBy("lang", "source", "other").agg(F.sum(first.cast("decimal(38,0)")).alias("first"), F.sum(second.cast("decimal(38,0)")).alias("second"))
    sides = one_sided.select("lang", "source", "other", F.col("first").alias("value")).unionByName(one_sided.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("second").alias("value")))

    inside = column_pairs(_with_totals(columns.where(F.size("counts") > 1), totals, fits))
    every = base.select("lang", "source", "other", F.col("value").cast("decimal(38,0)").alias("value")).unionByName(sides).unionByName(inside.withColumn("value", F.col("value").cast("decimal(38,0)")))
    found = every.groupBy("lang", "source", "other").agg(F.sum("value").cast("bigint").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    return found.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", rank.alias("rank"))


def _with_totals(columns: DataFrame, totals: DataFrame, fits: bool) -> DataFrame:
    """Columns with the totals of their sources, in their order."""
    if fits:
        by_lang = totals.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "total"))).alias("_of"))
        return columns.join(F.broadcast(by_lang), "lang").select("lang", "counts", "n", F.transform("counts", lambda c: F.element_at("_of", c["source"])).alias("totals"))
    each = columns.select("id", "lang", "n", F.explode("counts").alias("c")).select("id", "lang", F.col("n").alias("_n"), F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    met = each.join(totals.drop("v"), ["lang", "source"]).groupBy("id", "lang", "_n").agg(F.array_sort(F.collect_list(F.struct("source", "n", "total"))).alias("counts"))
    return met.select("lang", "counts", F.col("_n").alias("n"), F.col("counts.total").alias("totals"))


def _term_part(terms: DataFrame, known: DataFrame, fits: bool, last_rank: int) -> DataFrame:
    each = terms.select("lang", "term", F.aggregate("counts.n", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("all"), F.explode("counts").alias("c"))
    each = each.select("lang", F.col("c.source").alias("source"), "term", "all", F.col("c.n").alias("n")).join(_small(known, fits), ["lang", "source"])
    each = each.withColumn("p", probability(F.col("n"), F.col("tokens") + F.col("v"))).withColumn("q", probability(F.col("all"), F.col("lang_tokens") + F.col("v"))).where("p > q")
    each = each.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return each.withColumn("rank", rank).where(F.col("rank") <= last_rank).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
