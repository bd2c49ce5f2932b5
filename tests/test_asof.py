"""As-of joins against plain searches, and the page of every chunk."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking as C
from quarry.operators.asof import asof


def plain(left, right, within=None):
    out = []
    for k, at, v in left:
        fit = [] if k is None or at is None else sorted((a, x) for kk, a, x in right if kk == k and a is not None and a <= at)
        best = fit[-1] if fit and (within is None or at - fit[-1][0] <= within) else (None, None)
        out.append((k, at, v, best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, within", [(None, None), (7, None), (1000, None), (7, 20), (None, 3)])
def test_against_a_plain_search(spark, width, within):
    rng = random.Random(4)
    key = lambda: rng.choice(["a", "a", "a", "a", "b", "c", None])
    left = [(key(), rng.choice([None, *range(-50, 200)]), i) for i in range(400)] + [("a", 5, 1), ("a", 5, 1), ("only left", 1, 2)]
    right = [(key(), rng.choice([None, *range(-30, 150)]), rng.randint(0, 9)) for _ in range(80)] + [("only right", 1, 2)]
    a = spark.createDataFrame(left, "k string, at long, v long").repartition(4)
    b = spark.createDataFrame(right, "k string, at long, page long")
    got = asof(a, b, ["k"], "at", ["page"], width=width, within=within)
    assert got.columns == ["k", "at", "v", "page"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(left, right, within)


def test_empty_sides_and_clashing_names(spark):
    a = spark.createDataFrame([("a", 1, "x", 9)], "k string, at long, _row string, page long")
    none = spark.createDataFrame([], "k string, at long, page long")
    assert [tuple(r) for r in asof(a, none, ["k"], "at", ["page"]).select("k", "at", "_row", "page").collect()] == [("a", 1, "x", None)]
    assert asof(none, a, ["k"], "at", ["page"]).collect() == []


def test_pages_of_chunks_by_a_plain_search(spark):
    """Sections, windows, flagged and blank pages: each chunk has the page that it starts on."""
    rng = random.Random(8)
    docs = []
    for d in range(60):
        pages = []
        for p in range(rng.randint(0, 12)):
            text = rng.choice(["", "  ", "# Head\n" + "word. " * rng.randint(1, 200), "1. Title here\nbody " * rng.randint(1, 30), "x" * rng.randint(1, 900), "  led by white space. " * 9])
            pages.append((p + 1, text, rng.random() < 0.2))
        docs.append((d, pages))
    df = spark.createDataFrame(docs, "doc_id long, pages array<struct<page: int, text: string, flagged: boolean>>").repartition(3)
    want = []
    for d, pages in docs:
        kept = [(n, t.strip()) for n, t, flagged in pages if not flagged and t.strip()]
        starts = [sum(len(t) + 1 for _, t in kept[:i]) for i in range(len(kept))]
        for i, (begin, _, chunk) in enumerate(C.spans("\n".join(t for _, t in kept))):
            if len(chunk) >= C.SHORTEST:
                want.append((d, i, kept[max(bisect.bisect_right(starts, begin) - 1, 0)][0], chunk))
    assert sorted(tuple(r) for r in C.page_chunks(df).collect()) == sorted(want) and len(want) > 100


def test_no_join_and_one_shuffle(spark):
    docs = spark.createDataFrame([(1, [(1, "text", False)])], "doc_id long, pages array<struct<page: int, text: string, flagged: boolean>>")
    shown = C.page_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shown and shown.count("Exchange hashpartitioning") == 1
    assert C.page_chunks(docs.where(F.lit(False))).collect() == []
