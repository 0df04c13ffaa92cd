"""The stored index: commits, merges and block bounds against an index built anew and a search of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace import catalog
from loomtrace.plans import index, search

SESSION = "document_id string, source string, native_session_id string, source_path string, canonical_hash string, classification string, status string"
TURN = "document_id string, entry_id string, parent_entry_id string, role string, provenance string, timestamp string, content string"


def tables(spark, docs):
    """Sessions and turns of ``{document: (hash, path, status, [(entry, text)])}``."""
    s = [(d, "pi", d, path, h, "primary", status) for d, (h, path, status, _) in docs.items()]
    t = [(d, e, None, "user", None, "2026", text) for d, (*_, turns) in docs.items() for e, text in turns]
    return spark.createDataFrame(s, SESSION), spark.createDataFrame(t, TURN)


def texts(rng, n):
    words = ["granite", "harbour", "lights", "meadow", "the", "the", "the", "wall", "north", "rain", "été"]
    return [(f"e{k}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(n)]


def content(i):
    """All that a reader can see of an index, without the numbers of passages."""
    live = i.live(i.table("passages")).select(*index.KEYS, "text", "n_tokens").collect()
    entries = index._entries(i, i.table("postings")).select("term", *index.KEYS, "n_tokens", "positions").collect()
    terms = i.table("terms").groupBy("term").sum("n_passages", "n_documents").collect()
    documents = i.documents().select("document_id", "source_path", "canonical_hash", "n_passages", "n_tokens").collect()
    return sorted(map(tuple, live)), sorted(map(repr, map(tuple, entries))), sorted(tuple(r) for r in terms if r[1] or r[2]), sorted(map(tuple, documents)), i.passages, i.tokens


def test_merges_equal_a_new_index(spark, tmp_path):
    fan = 2
    rng, now, at = random.Random(4), {}, str(tmp_path / "index")
    for step in range(4):
        change = {f"d{rng.randint(0, 7)}": (f"h{step}", f"/p{step}", rng.choice([None, None, None, "empty_after_normalization"]), texts(rng, 3)) for _ in range(4)}
        for d in rng.sample(sorted(now), min(2, len(now))):
            change.setdefault(d, (now[d][0], f"/moved{step}", None, [("x", "not read, the hash is known")]))
        index.update(index.read(spark, at), *tables(spark, change), fan=fan)
        for d, (h, path, status, turns) in change.items():
            if status:
                now.pop(d, None)
            elif d in now and now[d][0] == h:
                now[d] = (h, path, None, now[d][3])
            else:
                now[d] = (h, path, None, turns)
    stored = index.read(spark, at)
    assert len(stored.segments) < 4
    anew = index.update(index.read(spark, str(tmp_path / "anew")), *tables(spark, now))
    assert content(stored) == content(anew)
    # an older version can still be read until its files are removed
    old = index.read(spark, at, 1)
    assert old.version == 1 and old.table("passages").count() == old.passages
    index.vacuum(spark, at, keep=1)
    assert content(index.read(spark, at)) == content(anew)
    assert {n.partition("=")[2] for n in index._list(spark, f"{at}/postings")} == {s.name for s in stored.segments}


def test_a_commit_that_fails_is_invisible(spark, tmp_path, monkeypatch):
    at, rng = str(tmp_path / "index"), random.Random(1)
    first = index.update(index.read(spark, at), *tables(spark, {"d1": ("h", "/p", None, texts(rng, 2))}))
    monkeypatch.setattr(index, "_publish", lambda i: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        index.update(first, *tables(spark, {"d1": ("h2", "/p", None, texts(rng, 2))}))
    monkeypatch.undo()
    assert index.read(spark, at) == first
    second = index.update(first, *tables(spark, {"d1": ("h3", "/p", None, [("e", "granite now")])}))
    assert [r.text for r in second.live(second.table("passages")).collect()] == ["granite now"]
    assert len(index.vacuum(spark, at, keep=1)) == 6  # a manifest, and the five tables of the lost segment


@pytest.mark.parametrize("terms", [["the"], ["granite", "the"], ["rain", "absent", "wall", "été"], ["absent"]])
def test_best_reads_few_blocks(spark, tmp_path_factory, terms):
    stored = stored_once(spark, tmp_path_factory)
    folded = [search.phrase(t)[0] for t in terms]
    folded = ["ete" if t == "été" else t for t in folded]
    got = index.best(stored, folded, 9)
    live = stored.live(stored.table("passages")).select(*index.KEYS, "timestamp", "text")
    want = search.scored(live, folded, ["document_id"]).orderBy("rank", *index.KEYS).limit(9)
    pick = lambda df: [(*[r[c] for c in index.KEYS], round(r["rank"], 9)) for r in df.orderBy("rank", *index.KEYS).collect()]
    assert pick(got.hits) == pick(want)
    if terms == ["the"]:
        assert got.entries > 1500 and got.entries_read * 5 < got.entries
    if terms == ["absent"]:
        assert got.entries == 0 and got.hits.count() == 0


_KEPT = {}


def stored_once(spark, factory):
    """An index of some thousand passages in three segments, with a document deleted and one replaced."""
    if "index" not in _KEPT:
        rng, at = random.Random(9), str(factory.mktemp("index"))
        for step in range(3):
            docs = {f"d{step}-{k}": ("h", "/p", None, texts(rng, 40)) for k in range(16)}
            index.update(index.read(spark, at), *tables(spark, docs), fan=9)
        index.update(index.read(spark, at), *tables(spark, {"d0-1": ("h2", "/p", None, texts(rng, 5)), "d1-1": ("h2", "/p", "empty_after_normalization", [])}), fan=9)
        _KEPT["index"] = index.read(spark, at)
    return _KEPT["index"]


def test_no_text_or_posting_is_kept_aside(spark, tmp_path, monkeypatch):
    """Commits and a merge keep nothing aside that grows with the texts."""
    rng, at, aside = random.Random(2), str(tmp_path / "index"), []
    monkeypatch.setattr(index, "checkpoint", lambda df, f=index.checkpoint: aside.append(set(df.columns)) or f(df))
    for step in range(2):
        index.update(index.read(spark, at), *tables(spark, {f"d{step}": ("h", "/p", None, texts(rng, 30))}), fan=2)
    assert aside and not [c for c in aside if c & {"content", "text", "entries", "places"}]


def test_passages_with_each_term(spark, tmp_path_factory):
    stored = stored_once(spark, tmp_path_factory)
    want = index._entries(stored, stored.table("postings")).groupBy("term").count().collect()
    assert sorted(map(tuple, index.passages_with(stored).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("text", ["", "a b", "É İx ß é1 the_wall", "ŻÓŁĆ-żółć İ"])
def test_token_count(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(F.size(search.tokens(F.col("t"))), search.token_count(F.col("t"))).first()
    assert row[0] == row[1]


def test_queries_leave_no_old_segments(spark):
    """Between the commits of a query only segments of the last version stay on disk."""

    def use(stored):
        assert {n.partition("=")[2] for t in index.TABLES for n in index._list(spark, f"{stored.path}/{t}")} == {s.name for s in stored.segments}
        return stored.documents().select("document_id")

    assert catalog._stored(spark, "/root/testdata/sf0.001", use, commits=3, fan=2).count() > 0
