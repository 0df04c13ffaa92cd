"""Each operator against a plain brute-force version, on odd rows, empty tables and the smallest input."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtrace.llm import bpe, chat, decontaminate, html_wrapper, line_dedup, quality, queries, sharding, simhash, spotsigs, token_count

from .conftest import ODD, SF

sha = lambda b: hashlib.sha256(b).hexdigest()


def documents():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def rows(df):
    return [tuple(r) for r in df.collect()]


def bag(found):
    return sorted(map(repr, found))


# -- 1


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    full = sharding.lookup_table(names, 2003)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 2003)
    assert np.mean((full != fewer) & (full != 19)) < 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 2000)


def test_place(spark, odd, none, tmp_path):
    found = rows(sharding.place(odd, ["doc_id"], queries.SHARDS))
    table = sharding.lookup_table(queries.SHARDS)
    for i, slot, shard in found:
        key = "\\N" if i is None else str(i)
        assert slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert shard == queries.SHARDS[table[slot]]
    assert len(found) == len(ODD) and sharding.place(none, ["doc_id"], ["one"]).count() == 0
    sharding.write_shards(odd.drop("bucket"), ["doc_id"], ["a", "b"], str(tmp_path / "s"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# -- 2, 3


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return bpe.load(f.read())


def test_bpe_matches_the_library(spark, odd, none, codec):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = ["a" * 3000, "　  x", "Ᲊ꟎1", "<|endoftext|>" * 3, "'S'll I'M"]
    for text in [t or "" for _, t in ODD + documents()] + more:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    want = []
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((text or "").encode())))
    assert bag(rows(bpe.round_trip(odd, path))) == bag(want)
    back = bpe.decode(bpe.encode(odd, path), path)
    assert bag(rows(back)) == bag((i, t or "") for i, t in ODD)
    assert bpe.round_trip(none, path).count() == 0


def test_token_counts_match_the_library(odd, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        machine = token_count.load(f.read())
    more = ["  a  b ", "▁x ▁", "==== ----\n\n\t", "<s><0x0A></s>", "中文é🎉" * 9]
    for text in [t or "" for _, t in ODD + documents()] + more:
        assert machine.count(text) == len(library.encode(text))
    for text in more + [documents()[0][1][:300]]:
        for chunk in (1, 2, 7):
            assert machine.count(text, chunk) == len(library.encode(text))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in ODD]
    assert bag(rows(token_count.count_tokens(odd, path))) == bag(want)
    assert token_count.count_tokens(none, path).count() == 0


# -- 4


def contaminated(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    by = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            by[tuple(w[i : i + n])].add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = word.findall(lower(text)), set(), set()
        for n in {len(k) for k in by}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in by:
                    hit |= set(range(k, k + n))
                    found |= by[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, odd, none, monkeypatch):
    t = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = list(zip(t["item_id"], t["text"], strict=True)) + [(900, "the lazy dog"), (901, None), (902, "!!"), (10, "a a a a a a a a a a a a a a a")]
    docs = documents() + ODD
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = bag(contaminated(docs, items))
    assert bag(rows(decontaminate.report(frame, bench))) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_LIMIT", 300_000)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    assert bag(rows(decontaminate.report(frame, bench))) == want
    assert decontaminate.report(none, bench).count() == 0
    assert all(r[2] == 0 for r in rows(decontaminate.report(odd, bench.limit(0))))


def test_fm_index():
    text = np.random.default_rng(3).integers(0, 5, 900)
    index = decontaminate.FMIndex(text)
    patterns = np.array([text[i : i + 4] for i in range(0, 800, 37)] + [[4, 9, 9, 9]])
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# -- 5


def test_quality(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(found[i], y) for i, y in truth.items() if found[i].held_out]
    assert len(held) > 30 and np.mean([r.predicted == y for r, y in held]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and (r.predicted == 1) == (r.score >= 0.3) for i, r in found.items())
    assert quality.score(odd, model).count() == len(ODD) and quality.score(none, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    unread = quality.train(none, labels)
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score(odd, unread).collect())


def test_word_vectors_and_pooling(spark, none, monkeypatch):
    monkeypatch.setattr(quality, "SHARE", 25)
    monkeypatch.setattr(quality, "BUCKETS", 3)
    monkeypatch.setattr(quality, "COUNTED", 2)
    monkeypatch.setattr("loomtrace.llm._common.PIECE", 50)
    texts = ["the cat sat on the mat", "the dog, the cat", None, "", "on", "rare " + "the cat " * 40, "é 中文 the"]
    tokens = [re.findall(r"\w+|[^\w\s]+", t or "") for t in texts]
    total, counts = sum(map(len, tokens)), defaultdict(int)
    for w in sum(tokens, []):
        counts[w] += 1
    own = sorted({quality._hash(w) for w, n in counts.items() if n * 25 >= total})
    row = lambda w: own.index(quality._hash(w)) if quality._hash(w) in own else len(own) + quality._hash(w) % 3
    want = np.zeros((len(own) + 3, quality.DIMS))
    for words in tokens:
        for i, w in enumerate(words):
            for c in words[max(0, i - quality.REACH) : i] + words[i + 1 : i + 1 + quality.REACH]:
                h = quality._hash(c) if quality._hash(c) in own else quality._hash(f"\0{quality._hash(c) % 3}")
                for k in range(quality.NONZERO):
                    want[row(w), (h >> 16 * k) % quality.DIMS] += 1 - 2 * (h >> 63 - k & 1)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = quality.word_vectors(frame)
    assert found.words.tolist() == own and 1 < len(own) < len(counts)
    assert np.allclose(found.table, want, atol=1e-6)
    means = [np.mean([want[row(w)] for w in words], axis=0) if words else np.zeros(quality.DIMS) for words in tokens]
    x = quality.pooled([t or "" for t in texts], found.rows(), found.table)
    assert np.allclose(x[:, :-1], means, atol=1e-5) and x[:, -1].tolist() == [float(bool(w)) for w in tokens]
    empty = quality.word_vectors(none)
    assert len(empty.words) == 0 and not empty.table.any()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * (x[:, 0] - x[:, 1] * x[:, 2])))
    y = (rng.random(4000) < p).astype(float)
    net = quality.fit(x[:3000], y[:3000])
    got = net.probability(x[3000:])
    loss = lambda q: -np.mean(np.log(np.where(y[3000:] == 1, q, 1 - q)))
    assert loss(got) < 0.85 * loss(np.full(1000, y.mean())) and abs(got.mean() - y[3000:].mean()) < 0.05
    assert loss(got) <= loss(net._replace(temperature=net.temperature * 3).probability(x[3000:]))
    assert quality.fit(x[:30], np.ones(30)).probability(x[:30]).mean() > 0.7


def test_quality_learns_from_every_label(spark, monkeypatch):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:20]
    docs = [(i, f"text of {i}") for i in ids] + [(ids[0], f"copy {k % 3}") for k in range(600)]
    labels = [(i, k % 2) for k, i in enumerate(ids)] + [(ids[1], 1)] * 50
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    monkeypatch.setattr(quality, "SAMPLE_ROWS", len(ids))
    fit, seen = quality.fit, []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)) or fit(x, y))
    for parts in (1, 7):
        quality.train(frame.repartition(parts), labels)
    (x, y), again = seen
    assert len(x) == len(ids) and y.sum() == len(ids) / 2
    assert np.allclose(x, again[0]) and (y == again[1]).all()


# -- 6


def test_html(spark):
    page = lambda k, more="": f"<html><head><title>t</title><script>x='<p>no</p>'</script></head><body><nav><ul><li><a>m{k}</a></li><li>n</li></ul></nav><div class='cookie-notice'>ok?</div><article><header><h1>Head {k}</h1></header><p>First<b>&amp;</b> part&nbsp; {k}<br>next<p>Second &lt;{k}&gt;{more}</p><aside>see also</aside></article><div id=comments><p>reader {k}</p></div><form>f</form><footer>&copy;</footer></body></html>"
    plain = lambda k: f"<div class=sidebar>s{k}</div><div>Same on all</div><div><p>Body {k}</p><p>More</p></div>"
    given = [(k, "http://a.example/x", page(k)) for k in range(5)] + [(10 + k, "http://b.example:80/", plain(k)) for k in range(4)] + [(30, None, None), (31, "x", ""), (None, "http://c.example", "<p>only"), (32, "http://a.example/y", page(7, "<em> odd</em>")), (33, "http://a.example/z", "<body class=has-sidebar><nav>n</nav><div><h1>Odd page</h1><figure>Fig <i>text</i></figure></div></body>")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in given], "page_id bigint, url string, html string, h int, roles string")
    found = {r.page_id: r.text for r in html_wrapper.main_text(frame).collect()}
    assert found[3] == "Head 3 First& part 3 next Second <3>"
    assert found[32] == "Head 7 First& part 7 next Second <7> odd"
    assert found[11] == "Body 1 More"
    assert found[33] == "Odd page Fig text"
    assert (found[30], found[31], found[None]) == ("", "", "only")
    assert html_wrapper.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_html_reads_every_distinct_page(spark, monkeypatch, limit):
    monkeypatch.setattr(html_wrapper, "BROADCAST_LIMIT", limit)
    copy = "<div><p>copied</p></div><div class=foot>Imprint</div>"
    article = lambda k: f"<div><p>story {k}</p></div><div class=foot>Imprint</div>"
    given = [(f"http://a.example/{k}", copy) for k in range(400)] + [("http://a.example/same", copy)] * 40  # copies outnumber the articles
    given += [(f"http://a.example/s{k}", article(k)) for k in range(3)] + [("http://a.example/m", "<div>outside</div><main><p>inside</p></main>")]
    given += [("http://b.example/", copy)] * 20
    given += [(f"http://c.example/{k}", f"<div>Note</div><p>c{k}</p>" + "<i>only here</i>" * (k == 0)) for k in range(5)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(given)], "page_id bigint, url string, html string").repartition(5)
    found = [r.text for r in html_wrapper.main_text(frame).orderBy("page_id").collect()]
    assert found[:440] == ["copied"] * 440 and found[440:444] == ["story 0", "story 1", "story 2", "inside"]
    assert found[444:464] == ["copied Imprint"] * 20  # one distinct page proves no template
    assert found[464:] == ["c0 only here", "c1", "c2", "c3", "c4"]


def test_html_reads_long_pages_to_their_end(spark):
    body = lambda k, n: "".join(f"<p>{k} {j}</p>" for j in range(n))
    page = lambda k, n: f"<div>{body(k, n)}</div><section>Imprint</section><ul><li>Terms</li><li>Contact</li></ul>"
    late = "".join(f"<i>link {j}</i>" for j in range(3000)) + "<article><p>the article</p></article>"
    given = [("http://a.example/", page(k, 3000 if k else 2)) for k in range(4)] + [("http://b.example/", late)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(given)], "page_id bigint, url string, html string")
    found = [r.text for r in html_wrapper.main_text(frame).orderBy("page_id").collect()]
    assert found == [" ".join(f"{k} {j}" for j in range(3000 if k else 2)) for k in range(4)] + ["the article"]
    wrapper = html_wrapper.infer([h for _, h in given[1:4]])
    assert [(n.path, n.says == html_wrapper.digest("Imprint"), len(n.pages)) for n in wrapper if n.path == "section"] == [("section", True, 3)]


def test_html_wrapper_is_union_free():
    pages = [f"<ul>{''.join(f'<li>{k}{j}</li><i>x</i>' for j in range(n))}</ul>{'<p>now</p>' * (n > 3)}<div>end</div>" for k, n in enumerate((2, 3, 5))]
    said = html_wrapper.expression(html_wrapper.infer(pages))
    assert said == "(?:<ul\x1fli><ul\x1fi>)+<p>?<div>"


def test_html_wrappers_match_all_their_pages():
    rng = np.random.default_rng(8)
    block = lambda: "".join(f"<{x}>t{rng.integers(3)}</{x}>" for x in rng.choice(list("abiqsu"), rng.integers(1, 5)))
    for _ in range(150):
        parts = [block() for _ in range(3)]
        pages = ["".join(parts[int(j)] * int(rng.integers(1, 4)) for j in rng.integers(0, 3, rng.integers(1, 5))) for _ in range(5)]
        wrappers = [html_wrapper.infer(pages), html_wrapper.align(html_wrapper.infer(pages[:2]), html_wrapper.infer(pages[2:]))]
        for wrapper in wrappers:
            back = html_wrapper.unpack(html_wrapper.pack(wrapper))
            assert html_wrapper.pack(back) == html_wrapper.pack(wrapper)
            language = html_wrapper.expression(wrapper, str)
            assert "|" not in language
            for page in pages:
                assert re.fullmatch(language, "".join(re.findall(r"<(\w)>", page))), (page, language)
            seen = defaultdict(set)
            for page in pages:
                for name, text in re.findall(r"<(\w)>([^<]*)<", page):
                    seen[name].add(text)
            for n in wrapper:  # a constant says what all pages say there
                assert n.says is None or len(seen[n.path]) > 0
            assert max(map([n.path for n in wrapper].count, seen)) <= html_wrapper.PLACES


def test_html_wrapper_decides(spark):
    """Unmarked templates: without wrappers all of their texts would stay."""
    made = {
        "http://a.example/": lambda k: f"<table><tr><td>Home</td><td>World</td></tr></table><div><h2>Title {k}</h2><p>Body <b>of</b> {k}</p><p>More {k}</p></div><center>All rights</center>",
        "http://b.example/": lambda k: f"<section><em>The Daily</em></section><ul>{''.join(f'<li>point {k} {j}</li>' for j in range(k + 1))}</ul>{'<blockquote>Sign up</blockquote>' * (k % 2)}<dl><dt>Contact</dt><dd>Imprint</dd></dl>",
        "http://c.example/": lambda k: f"<h1>Site</h1><main><h2>On {k}</h2><div>By our staff</div><p>text {k}</p></main>",
    }
    given = [(f"{u}{k}", f(k)) for u, f in made.items() for k in range(6)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(given)], "page_id bigint, url string, html string").repartition(4)
    found = [r.text for r in html_wrapper.main_text(frame).orderBy("page_id").collect()]
    want = [f"Title {k} Body of {k} More {k}" for k in range(6)] + [" ".join(f"point {k} {j}" for j in range(k + 1)) for k in range(6)] + [f"On {k} By our staff text {k}" for k in range(6)]
    assert found == want
    bare = html_wrapper.Wrapper.of([])
    assert all(html_wrapper.extract(h, bare) != w for (_, h), w in zip(given[:12], want[:12], strict=True))


def test_html_keeps_what_articles_share(spark):
    """Text of an article stays, however many pages of its host say the same, and however pages are dealt."""
    page = lambda k: f"<nav>Home</nav><article><h1>Recipe {k}</h1><h2>Ingredients</h2><ul><li>flour {k}</li><li>salt</li></ul><h2>Method</h2><p>Mix {k}.</p><blockquote>Serve warm.</blockquote></article><div class=footer>Imprint</div>"
    given = [(f"http://{n}.example/{k}", page(k)) for n in (1, 2, 3, 40) for k in range(n)]
    want = sorted((u, f"Recipe {k} Ingredients flour {k} salt Method Mix {k}. Serve warm.") for u, k in ((u, int(u.rpartition("/")[2])) for u, _ in given))
    for n in (1, 4, 13):
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(given)], "page_id bigint, url string, html string").repartition(n)
        assert sorted((r.url, r.text) for r in html_wrapper.main_text(frame).collect()) == want


def test_html_does_not_depend_on_how_pages_are_dealt(spark):
    """Irregular pages of one host without a main element."""
    rng = np.random.default_rng(3)
    block = lambda k: "".join(f"<{x}>{rng.choice(['Quote', 'Terms', f'story {k} {rng.integers(9)}'])}</{x}>" for x in rng.choice(["p", "div", "blockquote", "li", "h2"], rng.integers(3, 14)))
    given = [(k, f"http://a.example/{k}", block(k)) for k in range(12)]
    seen = set()
    for seed, n in ((0, 1), (1, 1), (2, 4), (3, 4), (4, 13)):
        order = [given[int(k)] for k in np.random.default_rng(seed).permutation(12)]
        frame = spark.createDataFrame(order, "page_id bigint, url string, html string").repartition(n)
        seen.add(tuple(sorted((r.page_id, r.text) for r in html_wrapper.main_text(frame).collect())))
    assert len(seen) == 1


def test_html_on_the_smallest_input(spark):
    import html

    t = pq.read_table(f"{SF}/pages.parquet").to_pydict()
    found = {r.page_id: r.text for r in queries.op6_html(spark, SF).collect()}
    for i, page in zip(t["page_id"], t["html"], strict=True):
        inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
        blocks = re.split(r"</?(?:p|h1|br|li|ul|div)[^>]*>", inner)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
        assert found[i] == " ".join(b for b in blocks if b)


# -- 7


def deduplicated(docs, least):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    seen = defaultdict(set)
    for k, (_, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            seen[key(line)].add(k)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not key(x) or len(seen[key(x)]) < least]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize(("limit", "whole"), [(1 << 25, 1 << 28), (0, 1 << 28), (0, 0)])
def test_line_dedup(spark, odd, none, monkeypatch, limit, whole):
    monkeypatch.setattr(line_dedup, "BROADCAST_LIMIT", limit)
    monkeypatch.setattr(line_dedup, "MAP_BITS", whole)
    monkeypatch.setattr(line_dedup, "PIECE_BITS", 1 << 14)
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 1 << 16)
    docs = documents() + ODD + [(100_000 + k, f"Shared Line\nonly {k}\n{'nine' if k < 9 else 'ten'}") for k in range(19)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert bag(rows(line_dedup.drop_frequent_lines(frame))) == bag(deduplicated(docs, 10))
    assert line_dedup.drop_frequent_lines(none).count() == 0
    clash = odd.select("doc_id", "text", F.col("n").alias("lines"), F.col("fp").alias("text_key"), F.col("k").alias("DROPS"))
    cleaned = line_dedup.clean(clash, 2)
    assert cleaned.columns == clash.columns
    assert bag(rows(cleaned)) == bag((i, t, 1, "x", 2) for i, _, _, t in deduplicated(ODD, 2))


def test_filters_merge_in_any_order():
    rng = np.random.default_rng(4)
    lines = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    tasks = [np.unique(rng.choice(lines, 900)) for _ in range(5)]
    of = [line_dedup.Seen(1 << 16) for _ in tasks]
    for seen, h in zip(of, tasks, strict=True):
        seen.add(h[:400], np.zeros(400, bool))
        seen.add(h[400:], np.zeros(len(h) - 400, bool))
    apart = line_dedup.Seen(1 << 16)
    for seen in of:
        apart.merge(seen.once.words, seen.twice.words)
    pairs = [line_dedup.Seen(1 << 16), line_dedup.Seen(1 << 16)]
    for k, seen in enumerate(reversed(of)):
        pairs[k % 2].merge(seen.once.words, seen.twice.words)
    pairs[0].merge(pairs[1].once.words, pairs[1].twice.words)
    assert (pairs[0].once.words == apart.once.words).all() and (pairs[0].twice.words == apart.twice.words).all()
    each, n = np.unique(np.concatenate(tasks), return_counts=True)
    assert apart.twice.has(each[n > 1]).all() and apart.twice.has(each[n == 1]).mean() < 0.2


def test_bloom():
    b = line_dedup.Bloom(1 << 16)
    h = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    b.add(h)
    assert b.has(h).all() and b.has(h + np.uint64(1)).mean() < 0.05


@pytest.mark.parametrize("bits", [64, 1 << 13])
def test_full_filters_lose_no_repeat(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
    monkeypatch.setattr(line_dedup, "MAP_BITS", 0)
    monkeypatch.setattr(line_dedup, "_filter_bits", lambda df, text_col: 3 * bits)
    rows_a_batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    docs = [(k, "\n".join(f"line {k % 200} {i}" for i in range(20)) + f"\nalone {k}") for k in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    try:
        found = [r.h for r in line_dedup.suspected(frame).collect()]
        kept = rows(line_dedup.drop_frequent_lines(frame))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    repeats = {np.uint64(line_dedup._hash(f"line {k} {i}".encode())).astype(np.int64) for k in range(200) for i in range(20)}
    assert len(found) == len(set(found)) and repeats <= set(found)
    assert bag(kept) == bag(deduplicated(docs, 10))


# -- 8


def spots(text):
    words = re.sub(r"[^\w]+|_", " ", (text or "").lower()).split()
    marked = ["#"] + ["#" if w in spotsigs.ANCHORS else w for w in words]
    content = [w for w in marked if w != "#"]
    out, k = set(), 0
    for w in marked:
        if w != "#":
            k += 1
        elif chain := content[k : k + 3]:
            out.add(hashlib.md5(" ".join(chain).encode()).hexdigest()[:8])
    return out


def test_spotsigs(spark, none):
    docs = documents() + [(i, t) for i, t in ODD if t is None or "中" not in t]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    spotsigs_rows = {(r.doc_id, r.edited_sha256): r for r in spotsigs.edited_pairs(frame).collect()}
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        r = spotsigs_rows[i, sha(edited.encode())]
        a, e, b = spots(text), spots(edited), spots(after)
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), "".join(sorted(a)), "".join(sorted(e)))
        assert r.near_edited == pytest.approx(like(a, e)) and r.near_next == pytest.approx(like(a, b))
    assert spotsigs.edited_pairs(none).count() == 0


def test_spotsigs_next_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 7)
    ids = [k * k for k in range(100)] + [16, None]
    frame = spark.createDataFrame([(i, f"t{i} {n}") for n, i in enumerate(ids)], "doc_id bigint, text string")
    ordered = sorted(rows(frame), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want = [(i, t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered)]
    assert bag(rows(spotsigs.with_next(frame, "doc_id", "text"))) == bag(want)


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)"])
def test_spotsigs_next_of_any_id_type(spark, kind):
    frame = spark.range(5000).select(F.expr(f"cast({'date_add(DATE\'2001-01-01\', cast(id as int))' if kind == 'date' else 'id * 7'} as {kind})").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    found = spotsigs.with_next(frame, "doc_id", "text")
    ordered = sorted(rows(frame))
    assert sorted(rows(found)) == [(i, t, ordered[(k + 1) % 5000][1]) for k, (i, t) in enumerate(ordered)]
    assert found.select("id").distinct().count() == 5000


def test_spotsigs_pairs_of_a_repeated_id(spark):
    text = lambda k, end: " ".join(f"the w{k}x{j} y{k}x{j} z{k}x{j}" for j in range(20)) + end
    docs = [(1, text(k, "")) for k in range(8)] + [(10 + k, text(k, f" the end{k}")) for k in range(8)]
    found = spotsigs.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r.a, r.b) for r in found) == [(1, 10 + k) for k in range(8)] and all(r.similarity >= 0.8 for r in found)


def test_spotsigs_pairs(spark):
    base = [f"the word{k} runs{k} far{k}" for k in range(40)]
    texts = {1: base, 2: base[:-1], 3: base[:20] + base[30:], 4: base, 5: ["other text"]}
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    sets = {i: spots(" ".join(t)) for i, t in texts.items()}
    want = {tuple(sorted((a, b))) for a in (1, 2, 3, 5) for b in (1, 2, 3, 5) if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {tuple(sorted((r.a, r.b))) for r in spotsigs.near_duplicates(frame).collect()} == want and want


# -- 9


def simhashed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(fps):
    """Component of each (id, fingerprint): smallest id, over all pairs within two bits."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        r = find(f)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, f, least[find(f)]) for i, f in fps]


def linked_names(docs):
    """Each row's component, by the smallest fingerprint in it."""
    fps = {simhashed(t) for _, t in docs}
    root = {f: c for _, f, c in linked([(f, f) for f in fps])}
    return [((i, t), root[simhashed(t)]) for i, t in docs]


def test_simhash(spark, none):
    docs = documents() + [d for d in ODD if len(d[1] or "") < 9000]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [(i, f % (1 << 64), c) for i, f, c in rows(simhash.near_duplicates(frame))]
    assert bag(got) == bag(linked([(i, simhashed(t)) for i, t in docs]))
    assert simhash.near_duplicates(none).count() == 0
    kept = rows(simhash.representatives(frame).select("doc_id", "text").distinct())
    name = dict(linked_names(docs))
    assert sorted(name[i, t] for i, t in kept) == sorted(set(name.values()))


@pytest.mark.parametrize("cell", [64, 3])
def test_simhash_links(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "PAIRED_CELL", cell)
    rng = np.random.default_rng(7)
    fps = set()
    for _ in range(30):
        seed = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(15):
            fps.add(seed)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                seed ^= 1 << int(b)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = rows(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")))
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in edges)
    from loomtrace.llm.graph import components

    least = dict(rows(components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    got = defaultdict(set)
    for f in signed:
        got[least.get(f, f)].add(f % (1 << 64))
    want = defaultdict(set)
    for _, f, c in linked(list(enumerate(fps))):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# -- 10


def talked(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, ts in by.items():
        ts.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in ts)
        learned = "".join(t for _, _, r, t in ts if r == "assistant")
        out.append((conv, len(ts), sha(told.encode()), len(learned), sha(learned.encode())))
    return out


def test_chat(spark):
    t = pq.read_table(f"{SF}/conversations.parquet").to_pydict()
    turns = list(zip(t["conv_id"], t["turn"], t["role"], t["text"], strict=True))
    turns += [(-1, 0, "user", queries._FORGED), (-1, 1, "assistant", queries._FORGED)]
    turns += [(500, k, ("user", "assistant")[k % 2], f"<|x\\<\\|\\\\ {k}\n" * (k * k % 97)) for k in range(60)]
    turns += [(501, 0, "system", "be"), (501, 0, "system", "be"), (501, 1, None, None), (501, None, "assistant", ""), (None, 3, "odd\nrole <\\n<|", "x" * 9000), (None, 4, "assistant", "y")]
    frame = spark.createDataFrame([(*r, 1, "w") for r in turns], "conv_id bigint, turn bigint, role string, text string, pos int, window string")
    parts = chat.windows(frame)
    assert bag(r[:5] for r in rows(chat.read_back(parts))) == bag(talked(turns))
    for r in parts.collect():
        told = [b.split("\n", 1)[1].replace("<\\|", "<|").replace("\\\\", "\\") for b in r.formatted.split(chat.END + "\n")[:-1]]
        cost = [-(-len(b) // 4) + 4 for b in told]
        own, repeated = cost[r.n_repeated :], cost[: r.n_repeated]
        assert sum(repeated) <= chat.BUDGET // 2 and (own[0] > chat.BUDGET // 4 and len(own) == 1 or sum(cost) <= chat.BUDGET)
    assert any(r.n_repeated for r in parts.collect())
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0


def test_chat_output_is_linear(spark):
    turns = [(1, 0, "system", "s" * 50_000)] + [(1, k, ("user", "assistant")[k % 2], "w" * 1500) for k in range(1, 400)]
    turns += [(2, 0, "system", "be kind")] + [(2, k, ("user", "assistant")[k % 2], "w" * 1500) for k in range(1, 400)]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r for r in chat.read_back(chat.windows(frame)).collect()}
    assert found[1].formatted_chars < 2 * sum(len(t[3]) for t in turns if t[0] == 1)
    parts = chat.windows(frame).where("conv_id = 2").collect()
    assert len(parts) > 100 and all("be kind" in r.formatted for r in parts)
    assert bag((i, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for i, r in found.items()) == bag(talked(turns))
