"""The change stream over appends, rewrites, torn tails, removals and restarts."""

import os

import pytest

from loomtrace.sources import changes, jsonl


@pytest.fixture
def place(tmp_path):
    (tmp_path / "logs" / "deep").mkdir(parents=True)
    return tmp_path


def put(place, name, text, mode="w", at=None):
    path = place / "logs" / name
    with open(path, mode, encoding="utf-8") as f:
        f.write(text)
    if at is not None:
        os.utime(path, ns=(at, at))


def run(spark, place, fail=False, **more):
    """One look: what a restarted query gives, and the records of its files."""
    got = []

    def step(batch, batch_id):
        rows = batch.collect()
        if fail:
            raise RuntimeError("lost")
        got.extend(rows)

    stream = changes.changes(spark, str(place / "logs"), str(place / "state"), **more)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(place / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    name = lambda r: r.path.rpartition("/logs/")[2]
    return sorted((name(r), r.change, None if r.content is None else [x.value["n"] for x in jsonl.read_lines(r.content)]) for r in got)


def test_four_batches(spark, place):
    put(place, "a.jsonl", '{"n": 1}\n')
    put(place, "deep/b.jsonl", '{"n": 2}\n{"n": 3')  # a torn tail
    put(place, "other.txt", "not looked at")
    assert run(spark, place) == [("a.jsonl", "added", [1]), ("deep/b.jsonl", "added", [2])]
    assert run(spark, place) == []
    put(place, "a.jsonl", '{"n": 4}\n', "a")
    put(place, "deep/b.jsonl", '}\n{"n": 5}\n', "a")
    assert run(spark, place) == [("a.jsonl", "changed", [1, 4]), ("deep/b.jsonl", "changed", [2, 3, 5])]
    put(place, "a.jsonl", '{"n": 9}\n{"n": 8}\n')  # rewritten in the same size
    put(place, "deep/b.jsonl", '{"n": 2}\n{"n": 3}\n{"n": 5}\n', at=10**18)  # only its time
    put(place, "c.jsonl", "")
    assert run(spark, place) == [("a.jsonl", "changed", [9, 8]), ("c.jsonl", "added", [])]
    os.remove(place / "logs" / "a.jsonl")
    put(place, "c.jsonl", '{"n": 7}\n')
    assert run(spark, place) == [("a.jsonl", "removed", None), ("c.jsonl", "changed", [7])]
    assert run(spark, place) == [] and len(os.listdir(place / "state" / "listings")) <= 2


def test_a_failed_batch_comes_again(spark, place):
    put(place, "a.jsonl", '{"n": 1}\n')
    assert run(spark, place) == [("a.jsonl", "added", [1])]
    put(place, "a.jsonl", '{"n": 2}\n', "a")
    with pytest.raises(Exception, match="lost"):
        run(spark, place, fail=True)
    put(place, "b.jsonl", '{"n": 3}\n')
    got = run(spark, place)
    assert ("a.jsonl", "changed", [1, 2]) in got
    assert sorted(got + run(spark, place)) == [("a.jsonl", "changed", [1, 2]), ("b.jsonl", "added", [3])]


def test_batches_are_bounded(spark, place):
    for k in range(3):
        put(place, f"{k}.jsonl", f'{{"n": {k}}}\n')
    seen = [run(spark, place, max_files=2) for _ in range(2)]
    assert [len(s) for s in seen] == [2, 1] and {n for s in seen for _, _, ns in s for n in ns} == set(range(3))
    for k in range(3):
        os.remove(place / "logs" / f"{k}.jsonl")
    assert [len(run(spark, place, max_files=2)) for _ in range(2)] == [2, 1]


def test_an_empty_folder(spark, tmp_path):
    assert run(spark, tmp_path) == []
