"""SpotSigs document fingerprints, with DataFrame functions alone.

A signature is a chain of up to three content words that follows a common word (an
anchor).  A fingerprint is the sorted set of a text's signature hashes.  Fingerprints
are compared by Jaccard similarity, which their sizes bound: sets whose sizes differ by
more than the threshold allows are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint

#: Common words (English, German, French, Spanish).
ANCHORS = (
    "the a an and of to in is it that was for on with as be by this are at from or have not but they you which had were "
    "der die das und ist in den von zu mit sich des dem nicht ein eine auf für im als auch er sie es war "
    "le la les de des du un une et est en que qui dans pour pas sur au aux avec il elle ce par plus "
    "el los las y es un una por con para se su lo como más pero al del"
).split()
CHAIN = 3
THRESHOLD = 0.8
_GAP = r"[^\p{L}\p{N}]+"


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes (8 hex digits) of a text.

    The text's start is an anchor too, and the text's end may cut a chain short, so any
    text with a word has a signature.  Null and wordless texts have none.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAP, " ")), " ")
    marked = F.concat(F.lit("# "), F.array_join(F.transform(words, lambda w: F.when(w.isin(ANCHORS), F.lit("#")).otherwise(w)), " "))
    marked = F.regexp_replace(marked, "(?:# )+", "# ")  # anchors in a row begin the same chain
    chains = F.regexp_extract_all(marked, F.lit(r"#(?= ([^ #]+(?: (?:# )?[^ #]+){0,%d}))" % (CHAIN - 1)), 1)
    hashed = F.transform(F.array_distinct(chains), lambda c: F.substring(F.md5(F.regexp_replace(c, "# ", "")), 1, 8))
    return F.array_sort(F.array_distinct(hashed))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, "")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``a``, ``b``, ``similarity``: pairs of different fingerprints at least ``threshold`` alike,
    each named by the smallest id that has it.  Inside, a class goes by the digest of its
    fingerprint, so texts that share an id stay apart (and may pair with each other).

    Repeated rows and equal fingerprints are one class; null ids never name one; empty
    fingerprints pair with nothing.  Fingerprints are partitioned by set size, so that a
    pair lies in equal or neighbouring partitions, and candidates share one of the
    signatures that are first in a set (rarest first) and that no pair alike enough can
    all miss.  Hot signatures come last in that order, so no posting list is long
    without its sets being alike.
    """
    sets = df.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("s")).where("size(s) > 0")
    classes = sets.groupBy("s").agg(F.min("id").alias("id")).where("id is not null")
    classes = checkpoint(classes.withColumn("c", F.md5(fingerprint(F.col("s")))))
    use = classes.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    ranked = classes.select("c", "id", F.size("s").alias("size"), F.explode("s").alias("sig")).join(use, "sig")
    order = Window.partitionBy("c").orderBy("n", "sig")
    heads = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(1 / threshold)) + 1e-9)
    heads = heads.select(F.struct("id", "c").alias("a"), "sig", F.col("size").alias("a_size"), band.alias("band"))
    other = heads.select(F.col("a").alias("b"), "sig", F.col("a_size").alias("b_size"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    close = (F.col("a_size") <= F.col("b_size")) & (F.col("a_size") >= F.col("b_size") * threshold - 1e-9) & ((F.col("a_size") < F.col("b_size")) | (F.col("a") < F.col("b")))
    pairs = heads.join(other, ["sig", "band"]).where(close).select(F.col("a.c").alias("ac"), F.col("b.c").alias("bc")).distinct()
    left, right = (classes.select(F.col("c").alias(f"{k}c"), F.col("id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    return pairs.join(left, "ac").join(right, "bc").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


#: Rows of a bucket of neighbouring ids, about; buckets at most, beyond which they hold more rows; ids sampled for a bound.
BUCKET_ROWS, BUCKETS, SAMPLED = 2_000, 1 << 20, 8


def _bounds(ids: DataFrame, wanted: int, rows: int) -> DataFrame:
    """One row with the array ``bounds``: about ``wanted`` of the ids, sorted, at even distances.

    They come from a sample of ``SAMPLED`` ids for each, and decide only where buckets
    are cut, never a result.  Any type that can be ordered will do.
    """
    sampled = ids.sample(min(1.0, SAMPLED * wanted / rows), 7).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return checkpoint(sampled.select(F.filter("ids", lambda _, i: i % SAMPLED == SAMPLED - 1).alias("bounds")))


def _bucket(id_: Column, bounds: Column, n: int) -> Column:
    """How many of ``n`` sorted bounds are at or below an id, by bisection; 0 for null."""

    def halve(span: Column, _: Column) -> Column:
        mid = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        up = (span["lo"] < span["hi"]) & F.coalesce(F.get(bounds, mid) <= id_, F.lit(False))
        return F.struct(F.when(up, mid + 1).otherwise(span["lo"]).alias("lo"), F.when(up, span["hi"]).otherwise(F.least(mid, span["hi"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve)["lo"]


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, ``next`` (text of the following row by id; the first follows the last).

    Null ids come first; ties are ordered by text.  Ids may have any type that can be
    ordered.  Rows are dealt once, into buckets of neighbouring ids whose number grows
    with the rows; the last row of a bucket takes the first text of the next bucket.
    Rows of one id share a bucket.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, least, nulls = rows.agg(F.count("*"), F.min("id"), F.count_if(F.col("id").isNull())).first()
    id_, bucket, n_bounds = F.col("id"), F.lit(0), 0
    if wanted := min(BUCKETS, n // BUCKET_ROWS) if least is not None else 0:
        found = _bounds(rows.select("id").where(id_ > F.lit(least)), wanted, n)
        if n_bounds := found.select(F.size("bounds")).first()[0]:
            rows = rows.withColumn("bounds", found.select("bounds").scalar())
            bounds = F.col("bounds")
            bucket, bound = _bucket(id_, bounds, n_bounds), F.get(bounds, F.col("bucket") - 1)
    rows = rows.withColumn("bucket", bucket)
    order = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("id"), "text")
    local = rows.select("bucket", "id", "text", F.lead("text").over(order).alias("next"))
    # every bound is an id, so the first row of a bucket is known by its id
    first = id_.isNull() if nulls else id_ == F.lit(least)
    if n_bounds:
        first = first | ((F.col("bucket") > 0) & (bound == id_))
    heads = rows.where(first).groupBy(F.pmod(F.col("bucket") - 1, F.lit(n_bounds + 1)).alias("bucket")).agg(F.min("text").alias("head"))
    return local.join(heads, "bucket", "left").select("id", "text", F.coalesce("next", "head").alias("next"))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last ``floor(n/4)`` code points replaced by the first as
    many of the next document.  Null texts read as empty; repeated rows stay and follow
    each other; a single row follows itself; an empty table gives an empty result.
    """
    pairs = with_next(df, id_col, text_col)
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 4)))"), F.substring(F.col("next"), F.lit(1), cut))
    sets = pairs.select("id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), signatures(F.col("text")).alias("s"), signatures(edited).alias("e"), signatures(F.col("next")).alias("n"))
    return sets.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), jaccard(F.col("s"), F.col("e")).alias("near_edited"), jaccard(F.col("s"), F.col("n")).alias("near_next"))
