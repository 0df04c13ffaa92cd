"""The audit against plain loops over all terms and pairs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomtrace.llm import source_audit

from .test_operators import bag, documents, rows

SCHEMA = "doc_id bigint, text string, lang string, source string, item string, rank string"


def brute(docs, least=3, last=200):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        count[lang, source].update(words)
        df[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n[s] + v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 1) // (sum(n.values()) + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, last)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return out


ODD = [
    ("The cat, the Cat and the dog", "en", "a"), ("a cat and A DOG", "en", "b"), ("cat; dog; and", "en", "c"), ("dog dog dog and ÀÉ àé", "en", "a"), ("ÀÉ", "en", "b"), ("ÀÉ x", "en", "b"),
    (None, "en", "quiet"), ("", "en", None), ("the the the", None, "a"), ("the", None, None), ("the", "", ""), ("solo solo", "one", "only"), ("solo", "one", "only"), ("solo", "one", "only"), ("1 2 3", "digits", "p"), ("...", "digits", "q"),
    ("cat " * 5000 + "dog", "en", "c"), ("cat and", "en", "b"), ("cat and", "en", "b"), ("中文 中文", "zh", "a"), ("中文", "zh", "b"), ("中文", "zh", "b"),
]


def given(spark, docs):
    return spark.createDataFrame([(k, *d, "i", "r") for k, d in enumerate(docs)], SCHEMA)


def test_odd_rows(spark):
    for n in (1, 6):
        got = rows(source_audit.audit(given(spark, ODD).repartition(n)))
        assert bag(got) == bag(brute(ODD))
    assert source_audit.audit(given(spark, [])).count() == 0
    assert source_audit.audit(given(spark, ODD).select(*[source_audit.F.lit(None).alias(c) for c in ("text", "lang", "source")])).count() == 0


@pytest.mark.parametrize(("limit", "block", "held"), [(1 << 25, 1 << 19, 200_000), (0, 3, 5)])
def test_many_sources_in_small_blocks(spark, monkeypatch, limit, block, held):
    monkeypatch.setattr(source_audit, "BROADCAST_LIMIT", limit)
    monkeypatch.setattr(source_audit, "BLOCK", block)
    monkeypatch.setattr(source_audit, "HELD_PAIRS", held)
    monkeypatch.setattr(source_audit, "HELD_TERMS", 20 if held == 5 else 300_000)
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    docs = [(" ".join(rng.choice(words[: int(rng.integers(1, 60))], int(rng.integers(0, 40)))), f"l{k % 2}", f"s{int(rng.integers(0, 9))}") for k in range(300)]
    got = rows(source_audit.audit(given(spark, docs).repartition(3), last_rank=7))
    assert bag(got) == bag(brute(docs, last=7))


def test_columns_are_shared(spark):
    """Terms with one column of counts are one row, and a pair of it is evaluated once."""
    docs = [("x y z", "en", s) for s in "abab"]
    terms = source_audit.kept_terms(source_audit.counted_terms(given(spark, docs)))
    assert terms.count() == 3 and terms.select("counts").distinct().count() == 1
    assert bag(rows(source_audit.audit(given(spark, docs)))) == bag(brute(docs))


def test_probability_of_large_counts(spark):
    big = 9_000_000_000_000
    df = spark.createDataFrame([(big, 3 * big), (0, 7), (6, 7)], "n bigint, total bigint")
    got = [r[0] for r in df.select(source_audit.probability(source_audit.F.col("n"), source_audit.F.col("total"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // t for n, t in ((big, 3 * big), (0, 7), (6, 7))]
    assert source_audit._probabilities(np.array([big]), np.array([3 * big])).tolist() == got[:1]
