"""Trees against a full comparison: the same differences, and reads that follow their number."""

import random

import duckdb
import pytest

from loomtrace import catalog_flow
from loomtrace.operators import merkle


def rows(spark, table, extra="flag"):
    return spark.createDataFrame([(k, h, f) for k, (h, f) in table.items()], f"id string, content_hash string, {extra} boolean")


@pytest.mark.parametrize("changes", [0, 3, 400])
def test_differences_and_reads(spark, tmp_path, changes):
    rng = random.Random(changes)
    left = {f"d{k}": (f"h{k}", k % 3 == 0) for k in range(4000)} | {None: ("x", None)}
    right = dict(left)
    for k in rng.sample(range(4000), changes):
        how = rng.randint(0, 3)
        if how == 0:
            del right[f"d{k}"]
        elif how == 1:
            right[f"d{k}"] = (None, k % 3 == 0)
        elif how == 2:
            right[f"d{k}"] = (f"h{k}", not k % 3 == 0)
        else:
            right[f"new{k}"] = ("n", None)
    depth = merkle.depth_for(4000)
    a, b = (merkle.write(rows(spark, t), "id", "content_hash", str(tmp_path / n), depth, ["flag"]) for t, n in ((left, "a"), (right, "b")))
    found = merkle.compare(a, b)
    want = {k for k in left.keys() | right.keys() if left.get(k) != right.get(k)}
    got = found.rows.collect()
    assert {r.id for r in got} == want and len(got) == len(want)
    for r in got:
        assert (r.left and (r.left.hash, r.left.flag)) == left.get(r.id) and (r.right and (r.right.hash, r.right.flag)) == right.get(r.id)
    assert found.rows_all == len(left) + len(right)
    # a leaf has some 16 to 64 rows a side, and only differing ones are read
    assert found.rows_read <= len(want) * 200 and (changes or found.nodes_read <= 16)


def test_empty_tables(spark, tmp_path):
    a = merkle.write(rows(spark, {}), "id", "content_hash", str(tmp_path / "a"), 1)
    b = merkle.write(rows(spark, {"x": ("h", True)}), "id", "content_hash", str(tmp_path / "b"), 1)
    assert merkle.compare(a, a).rows.count() == 0
    assert [(r.id, r.left, r.right.hash) for r in merkle.compare(a, b).rows.collect()] == [("x", None, "h")]
    with pytest.raises(ValueError, match="depth"):
        merkle.compare(a, b._replace(depth=2))


def test_repeated_keys(spark, tmp_path):
    given = lambda pairs: spark.createDataFrame(pairs, "id string, content_hash string")
    a = merkle.write(given([("x", "1"), ("x", "2"), ("y", "1"), ("y", "1"), (None, "1"), (None, "1")]), "id", "content_hash", str(tmp_path / "a"), 1)
    b = merkle.write(given([("x", "2"), ("x", "1"), ("y", "2"), ("y", "3"), (None, "1")]), "id", "content_hash", str(tmp_path / "b"), 1)
    got = sorted(((r.id or "", r.left and r.left.hash, r.right and r.right.hash) for r in merkle.compare(a, b).rows.collect()))
    assert got == [("", "1", None), ("y", "1", "2"), ("y", "1", "3")]


def test_the_query_is_its_sql(spark, tmp_path):
    """Ids below zero that are missing from both sides by their remainder, one of them made from 7565; repeated and null ids."""
    ids = [0, 1, 89, 97, 101, 101, 7565, 7565, -97, -5, -90, 8633, None]
    spark.createDataFrame([(i, f"text {n}" if n else None) for n, i in enumerate(ids)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalog_flow.ORACLE_SQL["tree_differences"]).fetchall())
    assert sorted(map(tuple, catalog_flow.QUERIES["tree_differences"](spark, str(tmp_path)).collect())) == want
    assert (-7566, "missing") in want
