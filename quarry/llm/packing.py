"""Packing documents into training sequences: best-fit decreasing with certified bin counts.

Pieces are dealt out by a hash; each partition packs its own by best-fit decreasing and compares
its number of bins with a lower bound from dual-feasible functions. A partition that meets its
bound is certified: no packing of its pieces has fewer sequences. Partitions with a gap keep their
full bins and exchange the documents of the others, which are dealt out anew and packed again, to fewer
partitions or, for MIXES rounds at most and while bins get fewer, to as many in another mix; all
until each is certified or one partition is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, slices
from quarry.llm.tokens import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"
PACK_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, open boolean"
#: Pieces that a partition packs at a time.
PARTITION_PIECES = 200_000
#: Rounds in which what is left goes to as many partitions again, in another mix.
MIXES = 3


def piece_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, tie -> PIECE_SCHEMA; only texts over capacity are cut, the first piece taking the rest."""
    encode = encoder(path).encode
    end = np.array([end_id], "<u4").tobytes()
    for batch in slices(batches, keep="encoder:" + path):
        rows = []
        encoded = encode([t or "" for t in batch.column("text").to_pylist()])
        for doc, tie, ids in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), encoded):
            ids += end
            n = len(ids) // 4
            size = n % capacity or capacity
            at = piece = 0
            while at < n:
                rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), tie))
                at, piece, size = at + size, piece + 1, capacity
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"]
        )


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, from counts of lengths 0..capacity.

    The best of three families of dual-feasible functions: the size itself; for each e, lengths
    above capacity - e as whole bins, those below e as nothing; and for each k, the rounding
    floor((k + 1) x) / k unless (k + 1) x is whole.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    many, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    for e in range(1, capacity // 2 + 1):
        large = int(many[capacity] - many[capacity - e])
        middle = int(weight[capacity - e] - weight[e - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each piece, fill of each bin) for lengths in decreasing order.

    Bins wait in lists by the room they have; a bitmap of the rooms that occur gives the least
    room that is enough.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, n = 0, 0
    where, offset, fills = [], [], []
    for size in lengths.tolist():
        fit = bits >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                bits &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
            fills.append(0)
        where.append(b)
        offset.append(fills[b])
        fills[b] += size
        if r > size:
            room[r - size].append(b)
            bits |= 1 << (r - size)
    return np.array(where, np.int64), np.array(offset, np.int64), np.array(fills, np.int64)


def pack_rows(batches: Iterator[pa.RecordBatch], capacity: int, turn: int) -> Iterator[pa.RecordBatch]:
    """PIECE_SCHEMA -> PACK_SCHEMA for one partition; open marks the pieces to be exchanged."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("tie", "ascending")])
    lengths = np.asarray(rows.column("length"))
    bins, offsets, fills = best_fit(lengths, capacity)
    gap = len(fills) > lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    base = (turn << 56) | (TaskContext.get().partitionId() << 32)
    for name, column in (("sequence_id", base + bins), ("offset", offsets), ("open", (fills[bins] < capacity) & gap)):
        rows = rows.append_column(name, pa.array(column))
    yield from rows.combine_chunks().to_batches(max_chunksize=50_000)


def _deal(pieces: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    return pieces.repartition(parts, F.xxhash64("doc_id", "piece", "tie", *[F.lit(seed)] * (seed > 0)))


def pack(pieces: DataFrame, capacity: int = 1024, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """PIECE_SCHEMA -> the same rows with sequence_id and offset.

    Each round has as many partitions as its pieces need; exchange ends when all are certified, one
    partition is left, or what is left needs as many partitions as before and another mix of it
    doesn't take fewer sequences or has been tried MIXES times.
    """
    pieces = materialize(pieces, "pieces")
    whole = pieces.where(F.col("length") == capacity)
    # A full piece is a sequence of its own; its id comes from its file and place in it.
    done = whole.select(*pieces.columns, F.monotonically_increasing_id().bitwiseOR(F.lit(127 << 56)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, turn, mixes = pieces.where(F.col("length") < capacity), 0, 0
    parts = max(1, -(-rest.count() // partition_pieces))
    out = [materialize(done, "packed")]
    bins = lambda df: df.select("sequence_id").distinct().count()
    before = None  # the open rows of the last round, where they were dealt to as many partitions again
    while True:
        packed = materialize(_deal(rest, parts, mixes).mapInArrow(lambda it, t=turn: pack_rows(it, capacity, t), PACK_SCHEMA), "packed")
        if before is not None and bins(packed) >= bins(before):
            out.append(before.drop("open"))
            break
        fewer = -(-packed.where("open").count() // partition_pieces) if parts > 1 else 0
        if fewer == 0 or (fewer == parts and mixes == MIXES):
            out.append(packed.drop("open"))
            break
        out.append(packed.where("NOT open").drop("open"))
        before = packed.where("open") if fewer == parts else None
        mixes += fewer == parts
        rest, parts, turn = packed.where("open").drop("sequence_id", "offset", "open"), fewer, turn + 1
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result.drop("tie")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null texts are empty and so one end token. Null ids stay null. Rows that repeat an id are
    documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie")
    )
    return pack(rows.mapInArrow(lambda it: piece_rows(it, tokenizer, end_id, capacity), PIECE_SCHEMA), capacity)
