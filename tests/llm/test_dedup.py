import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components as CC
from quarry.llm import near_dedup as N
from quarry.llm import suffix_dedup as S
from quarry.llm.exact_dedup import exact_duplicates, keep_largest
from quarry.llm.substring_kernels import repeats, sort_many, sort_suffixes, sort_texts
from tests.llm import brute
from tests.llm.conftest import frame


@pytest.mark.parametrize("share", [(17, 20), (4, 5)])
def test_near_duplicates_equal_brute_force(docs, texts, share):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, Fraction(*share)).collect()}
    assert got == brute.components(texts, *share)


def test_near_duplicates_in_small_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(N, "CLUSTER_BLOCK", 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs, Fraction(17, 20)).collect()}
    assert got == brute.components(texts, 17, 20)


def test_large_groups_settle_in_few_mixes(spark, monkeypatch):
    """Hundreds of near copies over tiny blocks become one component; beside them a chain of look-alikes
    below the threshold stays apart."""
    rng = random.Random(12)
    base = [rng.choice("abcdefgh") * 3 + str(i) for i in range(80)]
    near = [(i, " ".join("x" if rng.random() < 0.004 else w for w in base)) for i in range(300)]
    far = [(1000 + i, " ".join(base[: 80 - 7 * i] + [f"n{i}_{k}" for k in range(7 * i)])) for i in range(1, 6)]
    rows = near + far
    monkeypatch.setattr(N, "BUCKET_BLOCK", 20)
    monkeypatch.setattr(N, "CLUSTER_BLOCK", 1500)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(spark, rows).repartition(4), Fraction(17, 20)).collect()}
    assert got == brute.components(rows, 17, 20)


def test_near_duplicates_of_odd_rows(odd, empty, texts):
    rows = N.near_duplicates(odd).collect()
    assert len(rows) == len(texts) + 4
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)] * 3
    assert all(r.component_id == r.doc_id for r in rows if not r.n_shingles and r.doc_id is not None)
    assert N.near_duplicates(empty).collect() == []
    assert N.keep_one_per_group(odd).columns == odd.columns


def test_radius_is_kept_by_some_key():
    """Any two signatures within the radius share a key."""
    rng = np.random.default_rng(1)
    import pyarrow as pa

    limit = N.radius(0.85, N.INDEXED)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, N.INDEXED).astype(np.uint16)
        b = a.copy()
        at = rng.choice(N.INDEXED, limit, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, limit).astype(np.uint16)
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["rep", "sig"])
        out = next(N.key_rows(iter([batch]), 0.85)).to_pandas()
        assert set(out[out.rep == 1].key) & set(out[out.rep == 2].key)


@pytest.mark.parametrize("most", [1000, 2])
def test_components_of_paths_stars_and_loops(spark, monkeypatch, most):
    monkeypatch.setattr(CC, "HOT_EDGES", most)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in CC.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert CC.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_exact_duplicates(odd, empty, texts):
    rows = texts + texts[3:4] + [(None, texts[4][1]), (None, None), (None, "only here")]
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.lower(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[brute.lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(brute.lower(t).encode()).hexdigest()))
    assert sorted(map(tuple, exact_duplicates(odd).collect()), key=str) == sorted(want, key=str)
    kept = keep_largest(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_duplicates(empty).collect() == [] and keep_largest(empty).collect() == []


def test_exact_dedup_plan_has_no_python(docs):
    plan = exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_a_full_filter_costs_nothing_but_shuffling(docs, texts, monkeypatch):
    import quarry.llm.exact_dedup as E

    want = sorted(map(tuple, exact_duplicates(docs).collect()))
    monkeypatch.setattr(E, "BLOCKS", 1)
    assert sorted(map(tuple, exact_duplicates(docs).collect())) == want


@pytest.mark.parametrize("name, value", [("RANGE_ROWS", 9), ("HOT_ROWS", 2)])
def test_exact_dedup_in_ranges_and_with_hot_texts(odd, monkeypatch, name, value):
    import quarry.llm.exact_dedup as E

    want, kept = sorted(map(tuple, exact_duplicates(odd).collect()), key=str), sorted(r.text or "" for r in keep_largest(odd).collect())
    monkeypatch.setattr(E, name, value)
    assert sorted(map(tuple, exact_duplicates(odd).collect()), key=str) == want
    assert sorted(r.text or "" for r in keep_largest(odd).collect()) == kept


def test_few_texts_without_copies_are_shuffled(spark):
    """A table without copies passes nearly whole, also where its filter is split."""
    import quarry.llm.exact_dedup as E

    hashes = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    maybe, single = E.Filters(hashes, 20000).split(hashes)
    assert maybe.count() < 600 and maybe.count() + single.count() == 20000
    twice = hashes.union(hashes.limit(100))
    maybe, single = E.Filters(twice, 20100).split(twice)
    assert 200 <= maybe.count() < 1000 and maybe.count() + single.count() == 20100


def test_suffixes_are_sorted():
    rng = random.Random(5)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))]
        assert sort_suffixes(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeats_of_texts_equal_a_plain_search():
    rng = random.Random(8)
    for _ in range(200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 30))).encode() for _ in range(rng.randint(1, 6))]
        texts = list(dict.fromkeys(texts))
        places = [(i, 0) for i in range(len(texts))]
        gone = [bytearray(len(t)) for t in texts]
        for i, a, b in repeats(texts, places, 5):
            gone[i][a:b] = b"\1" * (b - a)
        want = brute.removals(list(enumerate(t.decode() for t in texts)), 5)
        assert [sum(g) for g in gone] == [want[i][1] for i in range(len(texts))]


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_removals_equal_brute_force(docs, texts, hot):
    out = S.remove_repeats(docs, hot=hot).select("c0", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in out} == brute.removals(texts, S.LENGTH)


def test_suffix_removals_of_odd_rows(odd, empty, texts):
    out = S.remove_repeats(odd).collect()
    assert len(out) == len(texts) + 4
    twice = [r for r in out if r.c0 == texts[3][0]]
    assert len(twice) == 2 and twice[0].kept == twice[1].kept
    assert S.remove_repeats(empty).collect() == []
    clean = S.without_repeats(odd)
    assert clean.columns == odd.columns
    assert all(r.n_chars == len(r.text) for r in clean.collect())


def test_suffix_removals_of_repeated_rows(spark, texts):
    """Each of two equal rows keeps what the row keeps where it stands alone."""
    want = brute.removals(texts, S.LENGTH)
    got = S.remove_repeats(frame(spark, texts + texts).repartition(5)).select("c0", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert len(got) == 2 * len(texts)
    assert all((r[1], r[2], r[3], bytes(r[4])) == want[r[0]] for r in got)


@pytest.mark.parametrize("most", [0, 3])
def test_suffix_removals_with_hot_minimizers(docs, texts, monkeypatch, most):
    """All or some minimizers are dealt out by windows, in all or in a part of their texts: no difference."""
    monkeypatch.setattr(S, "SAMPLED", 1)
    monkeypatch.setattr(S, "HOT_PIECES", most)
    rows = S.with_keys(docs, "doc_id", F.col("text")).select(*S.ROW, F.coalesce("text", F.lit("")).alias("text"))
    assert len(S.hot_minimizers(rows, S.LENGTH, S.GRAM)) > 20
    out = S.remove_repeats(docs).select("c0", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in out} == brute.removals(texts, S.LENGTH)


@pytest.mark.parametrize("shared_id", [None, 5])
def test_suffix_removals_of_rows_that_share_an_id(spark, shared_id):
    """Thousands of rows without an id, or with one and the same: each loses what repeats and no more."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    alone = ["".join(rng.choice("abcdefgh ") for _ in range(120 + rng.randrange(40))) for _ in range(2000)]
    rows = [(1, passage), (2, "short")] + [(shared_id, t) for t in alone] + [(shared_id, passage + t[:60]) for t in alone[:30]]
    out = S.remove_repeats(frame(spark, rows).repartition(5)).select("c0", "n_bytes", "kept").collect()
    kept = sorted(bytes(r.kept).decode() for r in out if r.c0 == shared_id)
    whole = [(0, passage)] + sorted(((1 + i, t) for i, (_, t) in enumerate(sorted((S_order(t), t) for d, t in rows if d == shared_id))))
    want = brute.removals(whole, S.LENGTH)
    assert kept == sorted(want[i][3].decode() for i, _ in whole if i) and sum(map(len, kept)) >= sum(map(len, alone))


def S_order(text):
    """k1 and k2 of a text: its md5 as two signed longs."""
    digest = hashlib.md5(text.encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 8], "big", signed=True) for i in (0, 8))


def test_equal_pieces_are_decided_by_the_sort(spark, monkeypatch):
    """Without the sort no byte of a document with one copy goes: hashes alone remove nothing there."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    two = frame(spark, [(1, text), (2, text)])
    spans = lambda: S.repeated_spans(S.with_keys(two, "doc_id", F.col("text")).select(*S.ROW, "text"))
    covered = sorted((r.a, r.b) for r in spans().collect())
    assert covered[0][0] == 0 and max(b for _, b in covered) == 900
    monkeypatch.setattr(S, "_sorted", lambda rows, length: rows.limit(0).selectExpr(*S.ROW, "CAST(0 AS LONG) AS a", "CAST(0 AS LONG) AS b"))
    assert spans().collect() == []


def test_many_texts_are_sorted_as_each_alone():
    rng = random.Random(6)
    for _ in range(100):
        texts = [[rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(1, 12))]
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        want = [s + i for s, t in zip(starts.tolist(), texts) for i in sorted(range(len(t)), key=lambda i: t[i:])]
        symbols = np.array(sum(texts, []), np.int64)
        assert sort_many(symbols, sizes).tolist() == want
        assert sort_texts(symbols, sizes).tolist() == want


def test_one_place_twice_is_no_repeat():
    text = b"abcdefgh"
    assert repeats([text, text], [(1, 0), (1, 0)], 5) == []
    assert repeats([text, text, text], [(1, 0), (2, 0), (2, 0)], 5) == [(1, 0, 8), (2, 0, 8)]
