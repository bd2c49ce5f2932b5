"""Very long texts, tables of one id, names that clash, and what ORC files skip."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import near_dedup as N
from quarry.llm import suffix_dedup as S
from quarry.llm import token_orc as O
from quarry.llm.bpe import round_trip
from quarry.llm.common import SLICE_BYTES
from quarry.llm.exact_dedup import exact_duplicates, keep_largest
from quarry.llm.language import identify
from quarry.llm.packing import pack_documents
from quarry.llm.quality import quality
from quarry.llm.tokens import public_path
from tests.llm import brute
from tests.llm.conftest import WORDS, frame

TOKENIZER = public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def long_rows():
    """A text longer than kernels take at a time, one that shares a passage with its end, and a copy."""
    rng = random.Random(21)
    words = [rng.choice(WORDS) + rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(80_000)]
    text = " ".join(words)
    assert len(text) > SLICE_BYTES
    return [(1, text), (2, "before it " + text[-400:-100] + " after it"), (3, text.upper()), (4, "short one")]


def test_long_texts(spark, long_rows):
    docs = frame(spark, long_rows).repartition(2)
    n = {i: len(brute.shingles(t)) for i, t in long_rows}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()} == {1: (n[1], 1), 2: (n[2], 2), 3: (n[3], 1), 4: (n[4], 4)}
    assert {r.doc_id: r.keep_id for r in exact_duplicates(docs).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in S.removal_report(docs).collect()} == {i: (len(t), 300 if i == 2 else 0) for i, t in long_rows}
    got = {r.doc_id: (r.n_words, r.kept) for r in quality(docs).collect()}
    assert got[1][0] == 80_000 and got[4] == (2, False)
    tokens = {r.doc_id: r.n_tokens for r in round_trip(docs, TOKENIZER).collect()}
    packed = pack_documents(docs, TOKENIZER).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: k + 1 for i, k in tokens.items()}
    assert {r.doc_id: r.n_tokens for r in O.token_output(docs, TOKENIZER).collect()} == {i: k + 1 for i, k in tokens.items()}
    assert identify(docs).count() == 4


@pytest.mark.parametrize("shared", [7, None])
def test_tables_of_one_id(spark, shared):
    """Many rows with one and the same id, or with none: each gets its answer."""
    texts = [f"text number {i % 90} of many that share an id and say so at some length {i % 90}" for i in range(300)]
    docs = frame(spark, [(shared, t) for t in texts]).repartition(3)
    rows = exact_duplicates(docs).collect()
    assert len(rows) == 300 and {r.keep_id for r in rows} == {shared} and sum(r.group_size for r in rows) == sum(texts.count(t) for t in texts)
    assert keep_largest(docs).count() == 90
    near = N.near_duplicates(docs).collect()
    assert len(near) == 300 and {(r.component_id, r.kept) for r in near} == {(shared, shared is not None)}
    assert N.keep_one_per_group(docs).count() == 300
    assert S.removal_report(docs).count() == quality(docs).count() == round_trip(docs, TOKENIZER).count() == identify(docs).count() == 300
    assert pack_documents(docs, TOKENIZER).count() == 300
    starts = sorted((r.start, r.n_tokens) for r in O.token_output(docs, TOKENIZER).collect())
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(300)]


def test_names_that_stages_use_themselves(spark):
    docs = spark.createDataFrame([(1, "one text", "a", "b", "c"), (2, "ONE TEXT", "d", "e", "f")], "doc_id long, text string, gone string, _gone string, cuts string")
    assert N.keep_one_per_group(docs).columns == docs.columns and N.keep_one_per_group(docs).first().cuts == "c"
    assert keep_largest(docs).first()._gone == "e" and S.without_repeats(docs).count() == 2


def scanned(df):
    """Rows that the scan of df gave on, after running it."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return len(rows), leaf.metrics().apply("numOutputRows").value()


def test_orc_skips_by_range_and_by_bloom_filter(spark, tmp_path):
    """A document is found in one row group, and an id between others that is not there in none."""
    docs = frame(spark, [(2 * i, f"text {i}") for i in range(6000)])
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        O.write_tokens(docs, path, TOKENIZER)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    found, read = scanned(O.read_tokens(spark, path, [4000]))
    assert found == 1 and read <= 1000
    found, read = scanned(O.read_tokens(spark, path, [4001]))
    assert found == 0 and read < 1000
    whole = O.read_tokens(spark, path).orderBy("doc_id").collect()
    assert [r.doc_id for r in whole] == [2 * i for i in range(6000)] and all(r.n_tokens == len(r.ids) for r in whole)


def test_files_follow_the_size_of_the_input(spark, tmp_path, monkeypatch):
    """Texts of many bytes go to more files than the session has partitions."""
    import os

    monkeypatch.setattr(O, "FILE_BYTES", 2000)
    docs = frame(spark, [(i, f"some text of a document {i} ") for i in range(1000)])
    O.write_tokens(docs, str(tmp_path / "t"), TOKENIZER)
    assert len([f for f in os.listdir(tmp_path / "t") if f.endswith(".orc")]) >= 12
    assert O.read_tokens(spark, str(tmp_path / "t")).count() == 1000
