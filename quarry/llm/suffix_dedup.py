"""Repeated substrings across documents, removed by suffix sorting in parts.

Every window of LENGTH bytes belongs to the piece around its minimizer, a gram of GRAM bytes that
equal windows share. Pieces are dealt out by the minimizer's hash, so all copies of a window meet.
Of equal pieces the earliest two go on, and what the suffix sort finds for the second holds for
those after it. Pieces that follow each other in both of two texts make chains, of which stretches are
sorted together; where a minimizer has different pieces, the earliest of each are. They are fetched,
and their suffixes are sorted by groups (see substring_kernels) to find equal windows. A minimizer
with more than HOT different pieces is dealt out anew, by half of the bytes that its
windows don't have in common yet, and again until no bucket has more; windows with nothing left
to differ in are all equal, so this ends. A minimizer that very many different pieces share, as a
sample of documents tells, is dealt out by single windows from the start, so that no task gets them
all; which way a piece goes makes no difference to what is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BYTE_VALUES, U64, materialize, mix, prefix_hash, release, slices, span_hash, string_buffers
from quarry.llm.near_dedup import _runs
from quarry.llm.substring_kernels import pieces, repeats_in

LENGTH = 100
GRAM = 32
#: Pieces that go to the suffix sort together; a bucket with more is dealt out anew.
HOT = 4096
#: Bytes of pieces that are suffix-sorted at a time, and windows of a chain that are sorted together.
SORTED_BYTES = 1 << 20
#: Rows that are Python objects at a time.
FEW = 1024
STRETCH = 256
#: One in so many documents is looked at for minimizers with more different pieces than this, and more
#: than one in HOT_MINIMIZERS of all; there are fewer than HOT_MINIMIZERS of them.
SAMPLED = 64
HOT_PIECES = 100_000
HOT_MINIMIZERS = 1 << 16
#: Pieces that a task remembers so that what repeats often is finished before the shuffle.
REMEMBERED = 1 << 17

#: A row's order: its id, rows without one last, then k1 and k2, zeros where ids are unique.
ROW = ["none", "doc", "k1", "k2"]
ROW_SCHEMA = "none boolean, doc long, k1 long, k2 long"
_PIECES = f"h long, ph long, {ROW_SCHEMA}, pos long, done boolean"
_BUCKET = f"h long, ph long, {ROW_SCHEMA}, pos long, common int, piece binary"


def _pack(start: np.ndarray, gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    """First byte, place of the gram in it and size of a piece in one long that sorts by place."""
    return (start << 16) | (gram << 8) | size


def _later(keys: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Whether each tuple of keys is greater than that of others."""
    out, tied = np.zeros(len(keys[0]), bool), np.ones(len(keys[0]), bool)
    for a, b in zip(keys, others):
        out |= tied & (a > b)
        tied &= a == b
    return out


class _Seen:
    """The second place at which pieces stood that a task has met, for some of them."""

    def __init__(self) -> None:
        self.columns = [np.zeros(REMEMBERED, x) for x in (np.uint64, np.uint64, bool, np.int64, np.int64, np.int64, np.int64)]

    def finished(self, h: np.ndarray, ph: np.ndarray, place: list[np.ndarray]) -> np.ndarray:
        """Pieces that come after two places already handed on."""
        at = (ph & U64(REMEMBERED - 1)).astype(np.int64)
        own = [c[at] for c in self.columns]
        return (own[0] == h) & (own[1] == ph) & _later(place, own[2:])

    def add(self, h: np.ndarray, ph: np.ndarray, place: list[np.ndarray]) -> None:
        at = (ph & U64(REMEMBERED - 1)).astype(np.int64)
        for column, values in zip(self.columns, (h, ph, *place)):
            column[at] = values


def counted_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """text -> h, n: the different pieces of each minimizer in a slice of texts."""
    for batch in slices(batches):
        h, ph = pieces(*string_buffers(batch.column("text")), length, gram)[-2:]
        both = np.unique(np.stack([h, ph]), axis=1)[0]
        h, n = np.unique(both, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def hot_minimizers(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """The minimizers of docs (ROW_SCHEMA, text) that too many different pieces share, by a sample."""
    some = docs.where(F.pmod(F.xxhash64(*ROW), F.lit(SAMPLED)) == 0).select("text")
    counts = some.mapInArrow(lambda it: counted_rows(it, length, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 1"), "sampled")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(HOT_PIECES / SAMPLED, total / HOT_MINIMIZERS)
    return np.array([r.h for r in counts.where(F.col("n") > most).select("h").collect()], np.int64).view(np.uint64)


def _windows(raw: np.ndarray, offsets: np.ndarray, cut: tuple[np.ndarray, ...], hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """cut, as pieces gives it, with the pieces of hot minimizers as their single windows."""
    far = np.isin(cut[4], hot)
    if not far.any():
        return cut
    d, start, at, size = (x[far] for x in cut[:4])
    n = size - length + 1
    ends = np.cumsum(n)
    step = np.arange(ends[-1]) - np.repeat(ends - n, n)
    d, start, at = np.repeat(d, n), np.repeat(start, n) + step, np.repeat(at, n) - step
    begin = offsets[d] + start
    one = span_hash(prefix_hash(BYTE_VALUES[raw]), begin, begin + length)
    two = span_hash(prefix_hash(mix(BYTE_VALUES * U64(0x9E3779B97F4A7C15))[raw]), begin, begin + length)
    made = (d, start, at, np.full(len(d), length), one, two)
    joined = [np.concatenate([x[~far], y]) for x, y in zip(cut, made)]
    order = np.lexsort((joined[1], joined[0]))
    return tuple(x[order] for x in joined)


def piece_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """ROW_SCHEMA, text -> _PIECES. What comes after two equal pieces that the task has handed on
    comes as finished intervals: done, from h to ph of the document."""
    seen = _Seen()
    for batch in slices(batches):
        raw, offsets = string_buffers(batch.column("text"))
        d, start, at, size, h, ph = _windows(raw, offsets, pieces(raw, offsets, length, gram), hot, length)
        if not len(d):
            continue
        rows = [np.asarray(batch.column(n)) if n != "none" else np.asarray(batch.column(n).to_pylist(), bool) for n in ROW]
        place = [r[d] for r in rows] + [_pack(start, at, size)]
        order = np.lexsort((*place[::-1], ph, h))
        moved = lambda x: x[order[1:]] != x[order[:-1]]
        fresh = np.concatenate([[True], moved(h) | moved(ph)])
        # Rows that repeat an id and text stand at one place: none is earlier or later than the other.
        new_place = fresh | np.concatenate([[True], np.any([moved(x) for x in place], axis=0)])
        nth = np.cumsum(new_place)
        nth -= np.repeat(nth[fresh], np.diff(np.append(np.flatnonzero(fresh), len(order)))) - 1
        later = np.zeros(len(d), bool)
        later[order[nth > 2]] = True
        later |= seen.finished(h, ph, place)
        second = order[new_place & (nth == 2)]
        second = second[~later[second]]
        seen.add(h[second], ph[second], [x[second] for x in place])
        keep = ~later
        yield _piece_batch(h[keep].view(np.int64), ph[keep].view(np.int64), [x[keep] for x in place], False)
        if later.any():
            d, start, end = d[later], start[later], (start + size)[later]
            head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (start[1:] > end[:-1])]))
            tail = np.append(head[1:], len(d)) - 1
            yield _piece_batch(start[head], end[tail], [r[d[head]] for r in rows] + [np.zeros(len(head), np.int64)], True)


def _piece_batch(h: np.ndarray, ph: np.ndarray, place: list[np.ndarray], done: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, ph, *place, np.full(len(h), done))], names=["h", "ph", *ROW, "pos", "done"])


def fetch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROW_SCHEMA, text, asked (h, ph, pos, size, again) -> _BUCKET and again."""
    for batch in slices(batches):
        data, offsets = string_buffers(batch.column("text"))
        raw = memoryview(data)
        asked = batch.column("asked")
        counts = np.diff(np.asarray(asked.offsets))
        flat = asked.flatten()
        h, ph, pos, size, again = (flat.field(n) for n in ("h", "ph", "pos", "size", "again"))
        owner = np.repeat(np.arange(batch.num_rows), counts)
        lo = offsets[owner] + (np.asarray(pos) >> 16)
        piece = pa.array([bytes(raw[a : a + n]) for a, n in zip(lo.tolist(), np.asarray(size).tolist())], pa.binary())
        common = pa.array(np.zeros(len(owner), np.int32))
        yield pa.RecordBatch.from_arrays(
            [h, ph, *[batch.column(n).take(pa.array(owner)) for n in ROW], pos, common, piece, again], names=["h", "ph", *ROW, "pos", "common", "piece", "again"]
        )


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, for what makes Python objects of them; memory of earlier tasks is given back first."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            yield batch.slice(at, FEW)


def chain_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """ROW_SCHEMA, first (the same), ahead, held (start, size) -> h, ROW_SCHEMA, pos, size: pieces that
    repeat those of another text at one distance, joined where they overlap and cut into stretches, each
    for both texts under one key."""
    for batch in _few_rows(batches):
        out = []
        columns = [batch.column(n).to_pylist() for n in (*ROW, "first", "ahead", "held")]
        for none, doc, k1, k2, first, ahead, held in zip(*columns):
            earlier = (first["none"], first["doc"], first["k1"], first["k2"])
            spans: list[list[int]] = []
            for a, n in sorted((x["start"], x["size"]) for x in held):
                if spans and a <= spans[-1][1] - length + 1:
                    spans[-1][1] = max(spans[-1][1], a + n)
                else:
                    spans.append([a, a + n])
            for begin, end in spans:
                for a in range(begin, end - length + 1, STRETCH):
                    n = min(STRETCH + length - 1, end - a)
                    key = _digest(repr((none, doc, k1, k2, earlier, ahead, a)).encode())
                    out.append((key, none, doc, k1, k2, a << 16, n))
                    out.append((key, *earlier, (a - ahead) << 16, n))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        made = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=["h", *ROW, "pos", "size"])


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def halved_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """_BUCKET -> _BUCKET: the windows of each piece in two groups, by whether half of the bytes that
    they need not share stand before what they share or after it. The bytes of that half, with the old
    key, are the new one; common has the bytes shared before and after the gram."""
    for batch in _few_rows(batches):
        out = []
        columns = [batch.column(n).to_pylist() for n in ("h", *ROW, "pos", "common", "piece")]
        for h, none, doc, k1, k2, pos, common, piece in zip(*columns):
            start, m, size = pos >> 16, (pos >> 8) & 255, pos & 255
            left, right = common >> 8, common & 255
            open_ = length - gram - left - right
            half = -(-open_ // 2)
            last = size - length  # the start of the last window in the piece
            edge = m - left - half  # windows from here back have half of the open bytes before
            key = h.to_bytes(8, "little", signed=True)
            if edge >= 0:
                cut = piece[: min(edge, last) + length]
                new = _digest(b"<", key, piece[edge : m - left])
                out.append((new, _digest(cut), none, doc, k1, k2, start << 16 | m << 8 | len(cut), (left + half) << 8 | right, cut))
            a = max(edge + 1, 0)
            if a <= last:
                cut, more = piece[a:], open_ - half + 1
                new = _digest(b">", key, piece[m + gram + right : m + gram + right + more])
                out.append((new, _digest(cut), none, doc, k1, k2, (start + a) << 16 | (m - a) << 8 | len(cut), left << 8 | (right + more), cut))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        made = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=["h", "ph", *ROW, "pos", "common", "piece"])


def sorted_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """h, ROW_SCHEMA, pos, piece sorted by h -> ROW_SCHEMA, a, b: spans that occur earlier. Buckets are whole."""
    release()
    for bounds, columns in _runs(batches, ["h"], [*ROW, "pos", "piece"]):
        none, doc, k1, k2 = (np.asarray(c) if i else np.asarray(c.to_pylist(), bool) for i, c in enumerate(columns[:4]))
        start, piece = np.asarray(columns[4]) >> 16, columns[5]
        size = np.asarray(pc.binary_length(piece)).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        s = 0
        while s < len(bounds) - 1:
            e = max(s + 1, int(np.searchsorted(total[bounds], total[bounds[s]] + SORTED_BYTES, side="right")) - 1)
            lo, hi = int(bounds[s]), int(bounds[e])
            bucket = np.repeat(np.arange(e - s), np.diff(bounds[s : e + 1]))
            s = e
            rows = [x[lo:hi] for x in (none, doc, k1, k2)]
            by = np.lexsort(rows[::-1])
            fresh = np.any([x[by[1:]] != x[by[:-1]] for x in rows], axis=0) if len(by) > 1 else np.zeros(0, bool)
            row = np.empty(hi - lo, np.int64)
            row[by] = np.concatenate([[0], np.cumsum(fresh)])
            raw = np.frombuffer(b"".join(piece.slice(lo, hi - lo).to_pylist()), np.uint8)
            i, a, b = repeats_in(raw, size[lo:hi], bucket, row, start[lo:hi], length)
            if len(i):
                at = start[lo:hi][i]
                yield pa.RecordBatch.from_arrays([pa.array(x[i]) for x in rows] + [pa.array(at + a), pa.array(at + b)], names=[*ROW, "a", "b"])


def removed_rows(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """text, cuts (a, b) and others -> the others, counts, hash and what is kept, as bytes or as text,
    in which a character cut in two goes whole."""
    for batch in slices(batches):
        n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            parts, spans, end = [], 0, -1
            for a, b in sorted((c["a"], c["b"]) for c in cuts or ()):
                if a > end:
                    parts.append(raw[max(end, 0) : a])
                    spans += 1
                end = max(end, b)
            parts.append(raw[max(end, 0) :])
            rest = b"".join(parts)
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(rest))
            n_spans.append(spans)
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
        own = [n for n in batch.schema.names if n not in ("text", "cuts")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in own]
            + [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string() if as_text else pa.binary())],
            names=[*own, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
SPAN_SCHEMA = ROW_SCHEMA + ", a long, b long"


def with_keys(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """docs with ROW. Where an id repeats, or several rows have none, k1 and k2 are a 128-bit hash of
    the text; where ids are unique they are zeros, which cost nothing to move."""
    repeated = docs.groupBy(F.col(doc_id).cast("long").alias("doc")).count().where("count > 1").limit(1)
    k1, k2 = F.lit(0).cast("long"), F.lit(0).cast("long")
    if repeated.count():
        digest = F.md5(text.cast("binary"))
        k1, k2 = (F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))
    doc = F.col(doc_id).cast("long")
    return docs.withColumns({"none": doc.isNull(), "doc": F.coalesce(doc, F.lit(0).cast("long")), "k1": k1, "k2": k2})


def _judged(rows: DataFrame, hot: int) -> DataFrame:
    """rows and kind: 0 for finished intervals, 1 for pieces after the second of equal ones, 2 for
    the earliest of different pieces of a bucket, 3 for those where there are more than `hot`, and 4 for
    second ones, with the place of the first. Pieces that nothing can repeat are left out."""
    equal = Window.partitionBy("key", "ph").orderBy(*ROW, "pos")
    bucket = Window.partitionBy("key")
    nth = F.col("nth")
    first = F.struct(*ROW, "pos")
    return (
        rows.withColumn("nth", F.dense_rank().over(equal))
        .withColumn("first", F.first(first).over(equal))
        .withColumn("low", F.min("ph").over(bucket))
        .withColumn("high", F.max("ph").over(bucket))
        .withColumn("n", F.count_if(nth == 1).over(bucket))
        .where("done OR nth > 1 OR low < high")
        .withColumn("kind", F.when(F.col("done"), 0).when(nth > 2, 1).when(nth == 2, 4).when(F.col("n") <= hot, 2).otherwise(3))
        .withColumn("first", F.when(F.col("kind") == 4, F.col("first")))
        .drop("nth", "low", "high", "n", "key")
    )


def _start(pos: Column) -> Column:
    return F.shiftright(pos, 16)


def _size(pos: Column) -> Column:
    return pos.bitwiseAND(F.lit(255)).cast("int")


def _whole(rows: DataFrame) -> DataFrame:
    """SPAN_SCHEMA of whole pieces."""
    at = _start(F.col("pos"))
    return rows.select(*ROW, at.alias("a"), (at + _size(F.col("pos"))).alias("b"))


def _chained(rows: DataFrame, length: int) -> DataFrame:
    """What to fetch (ROW_SCHEMA and a struct) for second pieces with the place of the first."""
    ahead = _start(F.col("pos")) - _start(F.col("first.pos"))
    held = F.collect_set(F.struct(_start(F.col("pos")).alias("start"), _size(F.col("pos")).alias("size"))).alias("held")
    pairs = rows.groupBy(*ROW, F.struct(*[F.col(f"first.{c}").alias(c) for c in ROW]).alias("first"), ahead.alias("ahead")).agg(held)
    cut = pairs.mapInArrow(lambda it: chain_rows(it, length), f"h long, {ROW_SCHEMA}, pos long, size int")
    return cut.select(*ROW, F.struct("h", F.lit(0).cast("long").alias("ph"), "pos", "size", F.lit(False).alias("again")).alias("ask"))


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """_BUCKET and again for wanted (ROW_SCHEMA, ask), from one pass over the texts."""
    asked = wanted.groupBy(*ROW).agg(F.collect_set("ask").alias("asked"))
    return docs.select(*ROW, "text").join(asked, ROW).mapInArrow(fetch_rows, _BUCKET + ", again boolean")


def _sorted(rows: DataFrame, length: int) -> DataFrame:
    buckets = rows.select("h", *ROW, "pos", "piece").repartition("h").sortWithinPartitions("h", *ROW, "pos")
    return buckets.mapInArrow(lambda it: sorted_rows(it, length), SPAN_SCHEMA)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """SPAN_SCHEMA: byte spans of docs (ROW_SCHEMA, text) covered by windows that occur earlier.

    `hot` is how many different pieces go to a sort together.
    """
    if not 0 < gram <= length or 2 * length - gram > 255:
        raise ValueError("a piece must fit in 255 bytes: gram <= length and 2 * length - gram <= 255")
    far = hot_minimizers(docs, length, gram)
    rows = docs.select(*ROW, "text").mapInArrow(lambda it: piece_rows(it, length, gram, far), _PIECES)
    # One shuffle by minimizer serves both windows; finished intervals are spread by their document.
    dealt = rows.withColumn("key", F.when(F.col("done"), F.xxhash64("doc", "h")).otherwise(F.col("h"))).repartition("key")
    known = materialize(_judged(dealt, hot).drop("done"), "pieces")
    out = known.where("kind = 0").select(*ROW, F.col("h").alias("a"), F.col("ph").alias("b")).union(_whole(known.where("kind = 1")))

    ask = F.struct("h", "ph", "pos", _size(F.col("pos")).alias("size"), (F.col("kind") == 3).alias("again")).alias("ask")
    wanted = known.where("kind IN (2, 3)").select(*ROW, ask).union(_chained(known.where("kind = 4"), length))
    fetched = _fetched(docs, wanted)
    dealt = None
    if known.where("kind = 3").limit(1).count():
        fetched = materialize(fetched, "fetched")
        dealt = fetched.where("again").drop("again")
    out = out.union(_sorted(fetched.where("NOT again"), length))
    while dealt is not None:
        # At most eight rounds: each halves the bytes in which the windows of a bucket may differ.
        halves = dealt.mapInArrow(lambda it: halved_rows(it, length, gram), _BUCKET)
        now = materialize(_judged(halves.withColumns({"key": F.col("h"), "done": F.lit(False)}), hot).drop("done"), "halves")
        chains = _fetched(docs, _chained(now.where("kind = 4"), length))
        out = out.union(_whole(now.where("kind = 1"))).union(_sorted(now.where("kind = 2"), length)).union(_sorted(chains, length))
        dealt = now.where("kind = 3").drop("kind", "first") if now.where("kind = 3").limit(1).count() else None
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """The columns of docs but text, and n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, or text).

    Every byte covered by a string of `length` bytes that also starts earlier (smaller doc_id, or
    the same document before) goes; strings are judged on the input and never cross documents.
    Null texts are empty. Rows without an id come after all others; rows that repeat an id or have
    none stand in the order of a 128-bit hash of their texts; rows that repeat id and text get the
    same answer each. Other columns pass through by position, so names may clash with those made
    here. An empty table gives an empty result.
    """
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    text = F.coalesce(F.col(names["text"]), F.lit(""))
    rows = with_keys(inner, names["doc_id"], text).withColumn("text", text).drop(names["text"])
    spans = repeated_spans(rows, length, gram, hot)
    cuts = spans.groupBy(*ROW).agg(F.collect_set(F.struct("a", "b")).alias("cuts"))
    joined = rows.join(cuts, ROW, "left").drop(*ROW)
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "cuts"))
    kept = REMOVED.replace("kept binary", "kept string") if as_text else REMOVED
    return joined.mapInArrow(lambda it: removed_rows(it, as_text), f"{own}, {kept}")


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    out = remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select(F.col("c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text; a character cut in two goes whole.

    The columns are those of docs; n_chars, where there is one, follows the text.
    """
    out = remove_repeats(docs, as_text=True)
    columns = []
    for i, name in enumerate(docs.columns):
        col = F.col("kept") if name == "text" else F.char_length("kept").cast(docs.schema[i].dataType) if name == "n_chars" else F.col(f"c{i}")
        columns.append(col.alias(name))
    return out.select(*columns)
