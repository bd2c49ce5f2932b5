"""Divergence of sources against a plain count of every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence as V

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, part string, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, seen, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(lower) for t in TERM.findall(text or "")]
        sources[lang].add(source)
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()

    def ranked(lang, source, part, values):
        for i, (item, v) in enumerate(sorted(values, key=lambda x: (-x[1], x[0].encode()))):
            if part == "pair" or i < top:
                out.add((lang, source, part, item, v, i + 1))

    for lang, own in sources.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((count[lang, s] for s in own), Counter()))
        p = {s: shares(count[lang, s]) for s in own}
        for s in own:
            ranked(lang, s, "pair", [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s])
            ranked(lang, s, "term", [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if count[lang, s][t] and p[s][t] > whole[t]])
    return out


def made(rng, n, sources, langs=("en", "fr", None)):
    words = [f"{a}{b}" for a in ("Alpha", "béta", "GAMMA", "дельта", "eps", "ß", "x") for b in "qwertzuiop"]
    rows = []
    for i in range(n):
        s = rng.choice([None, *(f"s{k}" for k in range(sources))]) if rng.random() < 0.7 else "s0"
        own = words[: 10 + (len(s or "") * 7 + i) % 60]
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randint(0, 30))) + rng.choice([" 12 ", ".", ""]), rng.choice(langs), s))
    return rows + [(None, "en", "no text"), ("", None, None), (" 1 2 ", "it", "numbers"), ("only once", "it", "other"), (None, None, "no text"), ("Rare rare", "xx", "alone")] + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(i % 7, t, lang, s, "clash", 5, "clash", 1) for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(5)


def rows_of(df):
    got = df.collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("sources", [3, 14])
def test_against_plain_counts(spark, sources):
    rows = made(random.Random(sources), 400, sources)
    got = rows_of(V.divergence(frame(spark, rows)))
    assert got == plain(rows)
    assert {p for _, _, p, *_ in got} == {"pair", "term"} and ("it", "numbers", "pair", "other", 0, 1) in got


def test_small_blocks_tiles_and_flushes(spark, monkeypatch):
    """Many blocks, tiles of a few terms, light and heavy terms: the same rows."""
    rows = made(random.Random(9), 300, 12)
    want = plain(rows)
    for block, tile, share, least in [(2, 3, 5, 2), (5, 4, 1, 50), (3, 1000, 5, 0)]:
        for name, value in (("BLOCK", block), ("TILE_ROWS", tile), ("LIGHT_SHARE", share), ("LIGHT_LEAST", least)):
            monkeypatch.setattr(V, name, value)
        assert rows_of(V.divergence(frame(spark, rows))) == want


def test_term_counts_flush(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(V, "HELD_TERMS", 3)
    monkeypatch.setattr("quarry.llm.common.SLICE_BYTES", 8)
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "a", "b"], "source": ["x", "x", "y"], "text": ["one Two two", "two three four", None]})
    total, df = Counter(), Counter()
    for b in V._count(iter([batch])):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
            df[r["lang"], r["source"], r["term"]] += r["df"]
    assert +total == {("a", "x", "one"): 1, ("a", "x", "two"): 3, ("a", "x", "three"): 1, ("a", "x", "four"): 1}
    assert df["a", "x", "two"] == 2 and ("b", "y", None) in total


def test_top_terms(spark):
    rows = [(f"w{chr(97 + i % 26)}{chr(97 + i // 26)} common", "en", "s1") for i in range(300) for _ in range(3)] + [("common", "en", "s2")] * 4
    got = rows_of(V.divergence(frame(spark, rows), top_terms=20))
    assert got == plain(rows, top=20) and sum(r[2] == "term" and r[1] == "s1" for r in got) == 20


def test_empty(spark):
    assert V.audit(frame(spark, [("a", "b", "c")]).limit(0)).collect() == []


def test_shares_at_large_counts(spark):
    """Exact where SCALE times a count passes 64 bits."""
    n, total, kept = 7_123_456_789_012, 8_999_999_000_000_000, 123_456
    want = 1 + 10**9 * (n + 1) // (total + kept)
    assert V.shares(np.array([n]), np.array([total]), kept)[0] == want
    assert spark.range(1).select(V.share(*(F.lit(x) for x in (n, total, kept)))).first()[0] == want
