"""Token ids in ORC: integer run-length encoded stripes in document order, with row indexes and a
Bloom filter on document ids, so that stripes are read in parallel and a search for documents
skips files, stripes and row groups by their metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh_path, slices
from quarry.llm.tokens import encoder

SCHEMA = "doc_id long, part int, seq long, part_start long, n_tokens long, ids array<int>"
#: Units that a worker remembers here, where little else needs its memory.
REMEMBERED = 1_500_000
#: Fixed at writing: stripe size, rows between index entries, false positives of the Bloom filter.
#: Bytes of text of a file, on average.
FILE_BYTES = 128 << 20
ORC_OPTIONS = {
    "orc.stripe.size": str(16 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "snappy",
}


def token_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text in document order -> SCHEMA; part_start counts the ids before it in its part."""
    encode = encoder(path, REMEMBERED).encode
    end = np.array([end_id], "<u4").tobytes()
    part, seq, start = TaskContext.get().partitionId(), 0, 0
    for batch in slices(batches, keep="encoder:" + path):
        ids = [np.frombuffer(x + end, "<i4") for x in encode([t or "" for t in batch.column("text").to_pylist()])]
        sizes = np.array([len(x) for x in ids], np.int64)
        ends = np.cumsum(sizes)
        n = len(ids)
        flat = pa.array(np.concatenate(ids).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(seq, seq + n)),
                pa.array(start + ends - sizes),
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat),
            ],
            names=["doc_id", "part", "seq", "part_start", "n_tokens", "ids"],
        )
        seq, start = seq + n, start + int(ends[-1])


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, `end_id` appended, in ascending id order to ORC files under out.

    Null texts are empty; null ids come last; rows that repeat an id stand side by side in order of
    a hash of their text. An empty table gives no rows. Documents are dealt out by id ranges, so a
    file holds a range of ids and min-max statistics separate files; there are as many as FILE_BYTES of
    text for each need, and as many as the session has shuffle partitions at least.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(lambda it: token_rows(it, tokenizer, end_id), SCHEMA).write.options(**ORC_OPTIONS).orc(out)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows written, or those of some documents: the filter reaches indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = np.asarray(ids.flatten()).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))])
        crc = [zlib.crc32(flat[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("part_start"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files under path.

    Only a row for each part, a count set at writing, is summed in one place and broadcast.
    """
    rows = read_tokens(spark, path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    crc = rows.select("doc_id", "part", "part_start", "ids").mapInArrow(
        _checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"
    )
    return crc.join(F.broadcast(starts), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs in the shared folder and give the index read from the files."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return token_index(spark, path)
