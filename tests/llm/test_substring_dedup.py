"""Repeated passages against a plain dictionary of windows, with every limit forced small as well."""

import re

import numpy as np
import pytest

from loomtrace.llm import _common, substring_dedup

from .conftest import ODD
from .test_operators import bag, documents, rows

SCHEMA = "doc_id bigint, text string, kept string, spans int, digest string"


def brute(docs, window=20):
    """``(id, words, removed, kept)`` a row; rows of one id and text are one document."""
    order = {}
    for i, text in docs:
        order.setdefault((i is None, i or 0, text or ""), re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    seen, gone = set(), {}
    for key in sorted(order):
        words, marked = order[key], set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                marked.update(range(i, i + window))
            seen.add(w)
        gone[key] = marked
    out = []
    for i, text in docs:
        key = (i is None, i or 0, text or "")
        kept = [w for k, w in enumerate(order[key]) if k not in gone[key]]
        out.append((i, len(order[key]), len(gone[key]), " ".join(kept)))
    return out


def found(spark, docs, parts=3, **more):
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in docs], SCHEMA).repartition(parts)
    got = substring_dedup.drop_repeats(df, **more)
    assert got.columns == [*df.columns, "n_words", "n_removed", "kept_", "spans_"]
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_) for r in got.collect()]


def sample(seed=0, n=120):
    """Texts with shared passages of many lengths, copies, periods and one passage in a third of them."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "中文", "a\x00b", " "]
    some = lambda k: [words[int(x)] for x in rng.integers(0, len(words), k)]
    passages, docs = [some(int(k)) for k in (19, 20, 21, 45, 300)], []
    for i in range(n):
        text = some(int(rng.integers(0, 90)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = passages[int(rng.integers(0, 5))]
        if i % 3 == 0:
            text += passages[2]
        if i % 10 == 0:
            text += ["la", "li"] * int(rng.integers(5, 60)) + ["lo"] * 30
        docs.append((int(rng.permutation(n)[0]) * 100 + i, "\t".join(text) if i % 4 == 0 else " ".join(text)))
    return docs + docs[:4] + [(docs[5][0], "other " + docs[6][1]), (None, docs[7][1]), (None, docs[8][1]), (-5, docs[9][1])]


def test_odd_rows_and_the_smallest_input(spark, none):
    docs = ODD + documents()
    assert bag(found(spark, docs)) == bag(brute(docs))
    assert substring_dedup.drop_repeats(none).count() == 0
    assert bag(found(spark, [(1, None), (2, ""), (3, " \n")])) == bag([(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, "")])
    with pytest.raises(ValueError):
        substring_dedup.drop_repeats(none, id_col="text")


@pytest.mark.parametrize("parts", [1, 5])
def test_shared_passages(spark, parts):
    docs = sample()
    assert bag(found(spark, docs, parts)) == bag(brute(docs))


@pytest.mark.parametrize("window", [3, 13, 50])
def test_other_windows(spark, window):
    docs = sample(1, 60)
    assert bag(found(spark, docs, window=window)) == bag(brute(docs, window))


@pytest.mark.parametrize("broadcast", [_common.BROADCAST_LIMIT, 0])
def test_small_limits(spark, monkeypatch, broadcast):
    """Large groups, groups whose list does not fit, parts of texts, and tasks that forget: the same rows."""
    for name, value in {"GROUP_BYTES": 2000, "PART_BYTES": 4000, "BLOCK_WORDS": 100, "HELD_BYTES": 3000, "REMEMBERED": 20, "HASHES": 50, "BROADCAST_LIMIT": broadcast}.items():
        monkeypatch.setattr(substring_dedup, name, value)
    docs = sample(2)
    df = spark.createDataFrame([(i, 0, t) for i, t in docs], "id bigint, digest bigint, text string")
    plan = substring_dedup.group_plan(df, 20)
    assert plan.everything if not broadcast else len(plan.large) > 0
    assert bag(found(spark, docs)) == bag(brute(docs))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(_common, "PIECE", 50)
    import pyarrow as pa

    text = " ".join(f"w{k % 37}" for k in range(500)).encode()
    cut = substring_dedup.Stretches(substring_dedup.Groups(16), 20)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array([text], pa.binary()).cast(pa.string())], ["id", "digest", "text"])
    windows = []
    for block in cut.blocks(iter([batch])):
        part, _, start, n, *_ = cut.cut(block)
        windows += [block[p][3] + s + k for p, s, m in zip(part.tolist(), start.tolist(), n.tolist(), strict=True) for k in range(m)]
    assert sorted(windows) == list(range(500 - 19))
    spans = [0, 20, 100, 130, 480, 500]
    words = text.split()
    assert substring_dedup._kept(text, spans) == (500, 70, b" ".join(words[20:100] + words[130:480]))
    assert substring_dedup._kept(text, []) == (500, 0, text)


def test_tree_nodes():
    rng = np.random.default_rng(0)
    texts = [[b"%d" % x for x in rng.integers(0, 2, 60)] for _ in range(5)]
    node = substring_dedup.deep_nodes([w for t in texts for w in t], np.full(5, 60), 7)
    places = {}
    for k, t in enumerate(texts):
        for i in range(60 - 7 + 1):
            places.setdefault(tuple(t[i : i + 7]), []).append(60 * k + i)
    for at in places.values():
        nodes = {int(node[i]) for i in at}
        assert len(nodes) == 1 and (nodes == {-1}) == (len(at) == 1)
    assert (node >= 0).sum() == sum(len(at) for at in places.values() if len(at) > 1)
