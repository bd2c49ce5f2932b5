import hashlib
import os
import zlib

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from quarry.llm import bpe, packing, token_orc  # noqa: E402
from quarry.llm.common import fresh_path  # noqa: E402
from quarry.llm.tokens import LibraryEncoder, encoder, public_path  # noqa: E402

PATH = public_path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="session")
def ids(library, texts):
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}


def crc(x):
    return zlib.crc32(np.asarray(x, "<u4").tobytes())


def test_encoders_equal_the_library(library):
    import random

    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "The", "é", "ß", "23", "'s", "'ll", "!", "...", "日本", "🙂", "<|endoftext|>", "\x1c", "\x85", "_", "²", "Ⅷ", "\xa0", "\x00"]
    own, numpy_codec = encoder(PATH), bpe.codec(PATH)
    samples = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["aaaa" * 500]
    for text, one, (two, decimal) in zip(samples, own.encode(samples), numpy_codec.encode(samples)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(one, "<u4").tolist() == want == np.frombuffer(two, "<u4").tolist(), repr(text)
        assert decimal.decode() == ",".join(map(str, want))
        assert numpy_codec.decode(np.array(want, np.int64)).decode() == library.decode(want, skip_special_tokens=False)


class Counted:
    """The library, with a count of the texts that it is given."""

    def __init__(self, library):
        self.library, self.given = library, 0

    def encode(self, text, **how):
        self.given += 1
        return self.library.encode(text, **how)

    def encode_batch_fast(self, texts, **how):
        self.given += len(texts)
        return self.library.encode_batch_fast(texts, **how)


def test_new_units_are_encoded_together(library):
    import random

    rng = random.Random(5)
    odd = ["'s", "'ll", "x's", "...", "日本", "🙂", "é\u0301", "\u0301a", "\x00", "\u200b", "²", "a\nb", "st.\nWhwh", "a\n\n", "b\r\nc", "12ab", "_", "<|x", "Ġ", "Ġa", "\ufeff"]
    new = ["".join(rng.choice("abcdeéßÄ") for _ in range(9)) + rng.choice(["", ".", ",***", "\nThe"]) for _ in range(20_000)]
    texts = [" ".join(["start", *new[i : i + 400], *rng.sample(odd, 12), "end"]) for i in range(0, len(new), 400)]
    own = LibraryEncoder(PATH)
    own.library = Counted(own.library)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.library.given < 20


def test_units_by_themselves_where_they_make_an_added_token(library):
    own = LibraryEncoder(PATH)
    own.added.append("a b")
    own.library = Counted(own.library)
    texts = ["x a c", "y d b", "z q a", "z b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    own.spaced[:] = False
    assert np.frombuffer(own.encode(["u v w"])[0], "<u4").tolist() == library.encode("u v w", add_special_tokens=False).ids


def test_broken_ids_decode_like_the_library(library):
    codec = bpe.codec(PATH)
    rng = np.random.default_rng(2)
    for _ in range(300):
        some = rng.integers(0, 50257, rng.integers(0, 8))
        assert codec.decode(some).decode() == library.decode(some.tolist(), skip_special_tokens=False)


def test_round_trip(docs, odd, empty, texts, ids):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(docs, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {i: (len(ids[i]), sha(",".join(map(str, ids[i]))), sha(t or "")) for i, t in texts}
    assert bpe.round_trip(odd, PATH).count() == len(texts) + 4
    assert bpe.round_trip(empty, PATH).collect() == []
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in texts}


def test_token_files(spark, docs, odd, empty, texts, ids):
    rows = {r.doc_id: tuple(r)[1:] for r in token_orc.token_output(docs, PATH, 0).collect()}
    start, want = 0, {}
    for i in sorted(ids):
        own = [*ids[i], 0]
        want[i] = (start, len(own), crc(own))
        start += len(own)
    assert rows == want
    strange = token_orc.token_output(odd, PATH, 0).orderBy("start").collect()
    ends = np.cumsum([r.n_tokens for r in strange]).tolist()
    assert [r.start for r in strange] == [0, *ends[:-1]] and [r.doc_id for r in strange[-3:]] == [None] * 3
    assert token_orc.token_output(empty, PATH, 0).collect() == []


def test_token_files_hold_indexes_and_filters(spark, docs, texts, ids):
    out = fresh_path(spark, "test-tokens")
    token_orc.write_tokens(docs, out, PATH)
    one = token_orc.read_tokens(spark, out, [texts[0][0]])
    assert [r.ids for r in one.collect()] == [[*ids[texts[0][0]], 0]]
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan or "PushedFilters: [IsNotNull(doc_id), " in plan
    import pyarrow.orc as orc
    from pathlib import Path

    files = sorted(Path(out.removeprefix("file://").removeprefix("file:")).glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == len(texts)


def check_packing(rows, want, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == crc(want[i][at : at + r.length])
            at += r.length
        assert at == len(want[i])
        assert len(parts) == 1 or all(r.length == capacity for r in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("most", [200_000, 7])
def test_packing(spark, docs, ids, most):
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "0L AS tie")
    pieces = rows.mapInArrow(lambda it: packing.piece_rows(it, PATH, 2, 1024), packing.PIECE_SCHEMA)
    want = {i: [*x, 2] for i, x in ids.items()}
    n = check_packing(packing.pack(pieces, 1024, most).collect(), want, 1024)
    lengths = [len(x) % 1024 for x in want.values() if len(x) % 1024]
    whole = sum(len(x) // 1024 for x in want.values())
    least = whole + packing.lower_bound(np.bincount(lengths, minlength=1025), 1024)
    assert n >= least and (most < 100 or n <= least + 1)


def test_packing_of_odd_rows(odd, empty, texts):
    rows = packing.pack_documents(odd, PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.doc_id is None for r in rows) == 3 and sum(r.piece == 0 for r in rows) == len(texts) + 4
    assert packing.pack_documents(empty, PATH).collect() == []


def test_lower_bounds_hold():
    """No packing that best fit finds is below the bound, and known optima are met."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes = np.sort(rng.integers(1, 21, rng.integers(1, 40)))[::-1]
        assert len(packing.best_fit(sizes, 20)[2]) >= packing.lower_bound(np.bincount(sizes, minlength=21), 20)
    assert packing.lower_bound(np.bincount([11] * 7 + [5] * 2, minlength=21), 20) == 7
    assert packing.lower_bound(np.bincount([7] * 6, minlength=21), 20) == 3


def test_packing_mixes_what_stays_open(spark, monkeypatch):
    """Lengths near a third leave most bins open; they are dealt anew, and no sequence is added."""
    lengths = np.random.default_rng(3).integers(300, 380, 400).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, 0) for i, n in enumerate(lengths)], packing.PIECE_SCHEMA)
    dealt, deal = [], packing._deal
    monkeypatch.setattr(packing, "_deal", lambda df, parts, *seed: dealt.append(parts) or deal(df, parts, *seed))
    rows = packing.pack(pieces, 1024, 100).collect()
    fills, mixed = {}, len(dealt)
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths)) and max(fills.values()) <= 1024
    monkeypatch.setattr(packing, "MIXES", 0)
    once = {r.sequence_id for r in packing.pack(pieces, 1024, 100).collect()}
    assert dealt[mixed - 2] == dealt[mixed - 1] and len(dealt) - mixed < mixed and len(fills) <= len(once)
