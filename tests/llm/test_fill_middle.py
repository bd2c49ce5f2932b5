"""The transformation against units in a list, and its bit vectors against plain counts."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fill_middle as M
from quarry.llm.common import SLICE_BYTES
from tests.llm.conftest import frame


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = ["a <P> b", "<S", "x<" * 40, "M>" * 30, "<P<S<M" * 9, "éa" * 50, "\U0001f600x\U0001f600" * 20, "a\nb\r\n\tc", "0" * 511, "ab" * 256, "|<>P>|S>", "\x00 nul \x7f"]


def test_every_text(spark, docs, texts):
    rows = texts + [(20_000 + i, t) for i, t in enumerate(ODD * 8)]
    out = M.fill_in_middle(frame(spark, rows).repartition(3)).withColumn("back", M.restored(F.col("form"), F.col("output")))
    got = {r.doc_id: r for r in out.collect()}
    forms = set()
    for i, t in rows:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i, t), t
        assert r.back == (t or "")
        forms.add(r.form)
    assert len(got) == len(rows) and forms == {"plain", "psm", "spm"}
    sums = {r.doc_id: r for r in M.digests(docs).collect()}
    for i, t in texts:
        assert sums[i].output_sha256 == hashlib.sha256(plain(i, t)[4].encode()).hexdigest()
        assert sums[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_odd_rows(spark, odd, empty, texts):
    rows = M.fill_in_middle(odd).collect()
    assert len(rows) == len(texts) + 4
    assert sorted((r.n, r.form, r.output) for r in rows if r.doc_id is None) == sorted((p[0], p[1], p[4]) for p in (plain(None, t) for t in (texts[4][1], None, "only here")))
    assert M.digests(empty).collect() == []


def test_long_text(spark):
    text = "some words, é and 12 numbers\n" * (SLICE_BYTES // 20)
    docs = frame(spark, [(1, text), (2, "short"), (3, text + "x")])
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in M.fill_in_middle(docs).collect()} == {i: plain(i, t) for i, t in ((1, text), (2, "short"), (3, text + "x"))}


@pytest.mark.parametrize("size, share", [(0, 0.5), (1, 1), (63, 0.5), (512, 0.01), (513, 1.0), (5000, 0.3), (5000, 0.001), (4096, 0.0)])
def test_rank_and_select(size, share):
    rng = np.random.default_rng(size)
    flags = rng.random(size) < share
    bits = M.Bits(flags)
    places = np.arange(size + 1)
    assert (bits.rank(places) == np.concatenate([[0], np.cumsum(flags)])).all()
    ones = np.flatnonzero(flags)
    assert (bits.select(np.arange(len(ones))) == ones).all()


def test_parameters(spark):
    docs = frame(spark, [(i, f"text number {i}") for i in range(400)])
    forms = lambda **k: {r.form: r["count"] for r in M.fill_in_middle(docs, **k).groupBy("form").count().collect()}
    assert set(forms(plain_share=0, suffix_first_share=0)) == {"psm"} and set(forms(plain_share=0, suffix_first_share=100)) == {"spm"}
    assert set(forms(plain_share=100)) == {"plain"}
    base = forms()
    assert 15 <= base["plain"] <= 75 and base["psm"] > base["spm"] and forms(seed=2) != base
