"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import corpus_pipeline

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import decontaminate, line_dedup, quality, simhash

from .conftest import ODD, SF
from .test_operators import contaminated, deduplicated, linked, simhashed


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        seen.append((name, before, after))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    (_, a, b), (_, c, d), (_, e, f), (_, g, h), (_, i, j) = seen
    assert set(b) < set(a) and len(b) > 0.6 * len(a) and all(b[x] == a[x] for x in b)
    want = {x: t for x, _, _, t in deduplicated([(x, r.text) for x, r in c.items()], 10)}
    assert {x: r.text for x, r in d.items()} == want and all(r.n_chars == len(r.text) for r in d.values())
    assert set(f) == {n for _, _, n in linked([(x, simhashed(r.text)) for x, r in e.items()])}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x for x, *_, verdict in contaminated([(x, r.text) for x, r in g.items()], items) if verdict}
    assert set(h) == set(g) - bad
    assert set(j) == set(i) and all(r.n_tokens == len(r.ids) for r in j.values())


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids"] and found.count() > 50


CLASHING = ["gone", "gone_", "lines", "text_key", "drops", "k", "taught", "label", "row", "h", "Host", "spans"]


def test_stages_on_odd_rows(spark, odd):
    """Nulls, repeats, empty and long texts, and columns named like those that operators make."""
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("bigint").alias("n_chars"), *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    items = [(1, "the lazy dog"), (2, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    pick = lambda df: sorted(map(repr, ((r.doc_id, r.text) for r in df.collect())))
    cleaned = line_dedup.clean(docs, 2)
    assert cleaned.columns == docs.columns
    assert pick(cleaned) == sorted(repr((i, t)) for i, _, _, t in deduplicated(ODD, 2))
    one = simhash.representatives(docs)
    assert one.columns == docs.columns
    names = {}
    for (i, t), (_, _, least) in zip(ODD, linked([(i, simhashed(t)) for i, t in ODD]), strict=True):
        names.setdefault(least, set()).add(simhashed(t))
    assert {simhashed(r.text) for r in one.collect()} <= set().union(*names.values()) and len({r.doc_id for r in one.collect()}) == len(names)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {(i, t) for (i, t), (*_, verdict) in zip(ODD, contaminated(ODD, items), strict=True) if verdict}
    assert bad and pick(kept) == sorted(repr((i, t)) for i, t in ODD if (i, t) not in bad)
    good = quality.keep_good(docs, quality.train(docs, spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id bigint, quality int")))
    assert good.columns == docs.columns and set(pick(good)) <= {repr(x) for x in ODD}


@pytest.mark.parametrize("rows", [0, 1])
def test_pipeline_on_hardly_any_rows(spark, odd, rows):
    docs = odd.limit(rows).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("bigint").alias("n_chars"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        assert docs.count() <= rows and (k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"])
