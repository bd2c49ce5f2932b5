"""Byte-level BPE in numpy: the symbols of many words in one flat array, merged in rounds.

A round finds the rank of every adjacent pair by binary search over the sorted pair keys, takes
the lowest rank of each word, and merges all its places in that word from left to right. Words
without a known pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import KEPT, slices
from quarry.llm.tokens import PRETOKEN

#: Pre-tokens that a worker remembers before it forgets them all.
REMEMBERED = 400_000
#: Bytes of new words merged at a time.
FLAT = 1 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        vocab: dict[str, int] = model["vocab"]
        chars = byte_characters()
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # Merging all places of a pair at once needs that no merge makes a pair of lower rank.
        born = {int(x): r for r, x in reversed(list(enumerate(self.result)))}
        if any(max(born.get(vocab[a], -1), born.get(vocab[b], -1)) >= r for r, (a, b) in enumerate(pairs)):
            raise ValueError("merges must come after those that make their parts")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True)) + ")").split if added else None
        back = {c: b for b, c in enumerate(chars)}
        pieces = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            pieces[i] = token.encode()
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.cut = regex.compile(PRETOKEN).findall
        self.known: dict[str, bytes] = {}
        self.decimal: dict[str, bytes] = {}

    def _merge(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and the word of each, word by word."""
        done_s, done_w = [], []
        none = len(self.result)
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            best = np.full(n, none, np.int64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(np.append(rank, none), first)
            best[word[first]] = low
            live = best[word] < none
            if not live.all():
                done_s.append(symbols[~live])
                done_w.append(word[~live])
            hit = (rank < none) & (rank == best[word[:-1]])
            # In a run of overlapping places every second one counts, from the left.
            at = np.flatnonzero(hit)
            if len(at):
                fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1)])
                start = np.maximum.accumulate(np.where(fresh, at, -1))
                at = at[(at - start) % 2 == 0]
                symbols = symbols.copy()
                symbols[at] = self.result[rank[at]]
            stay = live.copy()
            stay[at + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done_s:
            return symbols, word
        symbols, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        at = 0
        while at < len(words):
            raw, end, size = [], at, 0
            while end < len(words) and (end == at or size < FLAT):
                raw.append(words[end].encode("utf-8"))
                size += len(raw[-1])
                end += 1
            lengths = np.array([len(r) for r in raw], np.int64)
            symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            ids, word = self._merge(symbols, np.repeat(np.arange(len(raw)), lengths), len(raw))
            bounds = np.searchsorted(word, np.arange(len(raw) + 1))
            packed, text = ids.astype("<u4").tobytes(), ids.tolist()
            for i, w in enumerate(words[at:end]):
                s, e = int(bounds[i]), int(bounds[i + 1])
                self.known[w] = packed[4 * s : 4 * e]
                self.decimal[w] = ",".join(map(str, text[s:e])).encode()
            at = end

    def _words(self, texts: list[str]) -> list[list[str]]:
        cut = self.cut
        out = [cut(t) for t in texts]
        known = self.known
        new = {w for words in out for w in words if w not in known}
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                self.decimal.clear()
                new = {w for words in out for w in words}
            self.learn(list(new))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian uint32, decimal ids joined by commas) of each text."""
        if self.split_added and any(a in t for t in texts for a in self.added):
            return [self._encode_split(t) for t in texts]
        known, decimal = self.known, self.decimal
        return [(b"".join([known[w] for w in ws]), b",".join([decimal[w] for w in ws])) for ws in self._words(texts)]

    def _encode_split(self, text: str) -> tuple[bytes, bytes]:
        parts = [p for p in self.split_added(text) if p]
        known, decimal = [], []
        for p in parts:
            if p in self.added:
                known.append(np.array([self.added[p]], "<u4").tobytes())
                decimal.append(str(self.added[p]).encode())
            else:
                for w in self._words([p])[0]:
                    known.append(self.known[w])
                    decimal.append(self.decimal[w])
        return b"".join(known), b",".join(decimal)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids; bytes that are no text become replacement characters."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode("utf-8")


def codec(path: str) -> ByteBPE:
    """The worker's codec for a vocabulary file; tasks that use it go on with what it remembers."""
    key = "codec:" + path
    if key not in KEPT:
        KEPT[key] = ByteBPE(path)
    return KEPT[key]


def encode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, ids, ids_sha256, decoded, decoded_sha256."""
    bpe = codec(path)
    for batch in slices(batches, keep="codec:" + path):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        encoded = bpe.encode(texts)
        decoded = [bpe.decode(np.frombuffer(ids, "<u4").astype(np.int64)) for ids, _ in encoded]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(ids) // 4 for ids, _ in encoded], pa.int64()),
                pa.array([hashlib.sha256(d).hexdigest() for _, d in encoded], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def id_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in slices(batches, keep="codec:" + path):
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x, _ in bpe.encode([t or "" for t in batch.column("text").to_pylist()])]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])


def text_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in batches:
        texts = [bpe.decode(np.asarray(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: id_rows(it, tokenizer), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of each row of tokens (doc_id, ids)."""
    return tokens.select("doc_id", "ids").mapInArrow(lambda it: text_rows(it, tokenizer), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs, encoded and decoded again.

    Null texts are empty; null ids stay null; repeated rows each get a row; the strings of added
    tokens in a text become those tokens; other columns are not read; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: encode_rows(it, tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
