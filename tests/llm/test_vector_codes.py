"""Vector codes against plain loops, on odd rows and with labels of every size."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from loomtrace.llm import queries, vector_codes

from .conftest import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string"


def brute(rows):
    """``{(id, vector): (code, error)}`` and the digest, one distance at a time."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = [(i, [math.floor(Fraction(x) * 4096) for x in v]) for i, v in kept]
    if not cut:
        return {}, None
    cut.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(cut[0][1])
    cut = [(i, v) for i, v in cut if len(v) == size]
    w = size // 8
    books = [[v[p * w : p * w + w] for _, v in cut[:16]] for p in range(8)]

    def nearest(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v[p * w : p * w + w], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        new = []
        for p in range(8):
            groups = {}
            for _, v in cut:
                groups.setdefault(nearest(p, v)[1], []).append(v[p * w : p * w + w])
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    found = {}
    for i, v in cut:
        best = [nearest(p, v) for p in range(8)]
        found[i, tuple(v)] = "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_matches_plain_loops(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(60, 16)).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(points)]
    rows += [(70, None), (71, [float("nan")] + points[0][1:]), (72, [None] + points[0][1:]), (73, [float("-inf")] + points[0][1:]), (None, points[3]), (5, points[5]), (5, points[6])]
    rows += [(74, [2.0**101] + points[0][1:]), (75, [-0.0001] * 16), (76, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, None if (i or 0) % 3 == 0 else (i or 0) % 3, "x", "y") for i, v in rows], SCHEMA).repartition(5)
    got = vector_codes.compress(df).collect()
    found, digest = brute(rows)
    clean = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = sorted((repr(i), *found[i, tuple(math.floor(Fraction(x) * 4096) for x in v)]) for i, v in clean)
    assert sorted((repr(r.vec_id), r.code, r.error) for r in got) == [(i, c, min(e, vector_codes.LONG)) for i, c, e in want]
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress(none).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).count() == 0
    few = spark.createDataFrame([(1, [1.0] * 8, None, "", ""), (2, [2.0] * 8, None, "", ""), (3, [2.0] * 9, 4, "", ""), (4, [2.0], 4, "", "")], SCHEMA)
    got = {r.vec_id: r for r in vector_codes.compress(few).collect()}
    assert (got[1].code, got[2].code, got[1].error, got[1].label_error) == ("00" * 8, "01" * 8, 0, 0)
    assert got[3].code is None and got[3].error is None and len(got) == 4
    empty = spark.createDataFrame([(1, [], 1, "", "")], SCHEMA)
    assert vector_codes.compress(empty).first().code == "00" * 8
    # further columns stay, also those named like the new ones
    coded = vector_codes.encode(few, vector_codes.train(few))
    assert coded.columns == [*few.columns, "code_", "error_"] and coded.count() == 4


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_annulus_is_exact_and_prunes(scale):
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (16, 8)) * rng.integers(1, 30, (16, 1))
    parts = np.repeat(centres, 25, axis=0) + rng.integers(-40, 40, (400, 8))
    entries = [[int(x) * scale for x in row] for row in centres]
    parts = parts.astype(object) * scale if scale > 1 else parts
    book = vector_codes.Codebook(entries, 8)
    index, distance = book.nearest(parts)
    for row, k, d in zip(parts.tolist(), index.tolist(), distance.tolist(), strict=True):
        assert (d, k) == min((sum((x - y) ** 2 for x, y in zip(row, e, strict=True)), n) for n, e in enumerate(entries))
    assert book.evaluated < 0.7 * len(parts) * len(entries)
    # equal entries: the lowest index
    same = vector_codes.Codebook([[1, 1], [1, 1], [0, 0]], 2)
    assert same.nearest(np.array([[1, 1], [2, 2], [0, 0]]))[0].tolist() == [0, 0, 2]


def test_sums_of_hot_and_cold_labels(spark, monkeypatch):
    rows = [(k, None if k % 2 else k % 40, k) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, label int, error bigint")
    want = sorted((k, sum(e for _, m, e in rows if m == label)) for k, label, _ in rows)
    for limit, hot in ((1 << 20, 10), (0, 3), (0, 100_000)):
        monkeypatch.setattr(vector_codes, "BROADCAST_LIMIT", limit)
        monkeypatch.setattr(vector_codes, "HOT_LABELS", hot)
        got = vector_codes.with_group_sum(df, "label", "error", "total")
        assert sorted((r.id, r.total) for r in got.collect()) == want


def test_query_does_not_depend_on_partitions(spark):
    got = queries.op11_vector_codes(spark, SF)
    again = vector_codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet").repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
