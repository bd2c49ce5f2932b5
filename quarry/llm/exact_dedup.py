"""Exact duplicate documents: two-pass Bloom filtering in DataFrame expressions only.

Pass one deals text hashes over blocks, about one hash for each, and sets one of a block's 64 bits
for each row; counts and bits are combined in the map tasks first. A block in which fewer bits are
set than rows were counted may hold a repeated text. Pass two tests every row against these blocks:
a row of another block has a text that no other row has, and passes straight through; only the
others, the truly repeated and one or two in a hundred more, are shuffled and grouped. The filter
has as many blocks as there are rows. Hashes are split into ranges of RANGE_ROWS rows, each with a
filter of its own, so a broadcast has RANGE_ROWS / 64 rows of two longs at most at any size of
input; a fuller filter costs shuffling, never correctness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: Rows for which there is one filter, and blocks that it has at most: 8 MB of longs to broadcast.
RANGE_ROWS = 1 << 25
BLOCKS = 1 << 25
#: A text with more rows than this, and more than one in HOT_TEXTS of all rows, is joined by broadcast;
#: there are fewer than HOT_TEXTS of them.
HOT_ROWS = 1000
HOT_TEXTS = 1 << 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """text with A-Z lower-cased, null as empty. Pure ASCII takes the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _block(sha: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(blocks))


def _range(sha: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(3)), F.lit(ranges)).cast("int")


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def repeated_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """(word, bits): the blocks in which two or more rows of hashes (sha) may share a text, 64 to a word."""
    bit = F.pmod(F.xxhash64("sha", F.lit(2)), F.lit(64))
    cells = hashes.select(_block(F.col("sha"), blocks).alias("block"), _one(bit).alias("bit"))
    full = cells.groupBy("block").agg(F.count("*").alias("n"), F.bit_or("bit").alias("bits")).where(F.col("n") > F.bit_count("bits"))
    word = F.shiftright("block", 6).alias("word")
    return full.groupBy(word).agg(F.bit_or(_one(F.col("block").bitwiseAND(F.lit(63)))).alias("bits"))


def _split(rows: DataFrame, bloom: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(rows that may share their sha, rows that do not)."""
    tested = rows.withColumn("_block", _block(F.col("sha"), blocks))
    tested = tested.join(F.broadcast(bloom), F.shiftright("_block", 6) == bloom.word, "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(_one(F.col("_block").bitwiseAND(F.lit(63)))) != 0, F.lit(False))
    return tested.where(hit).drop("_block", "word", "bits"), tested.where(~hit).drop("_block", "word", "bits")


class Filters:
    """The filters of a table of hashes (sha) with n rows, one for each range."""

    def __init__(self, hashes: DataFrame, n: int):
        self.ranges = max(1, -(-n // RANGE_ROWS))
        self.blocks = min(BLOCKS, max(64, -(-n // self.ranges)))
        dealt = self._dealt(hashes.select("sha"))
        self.blooms = [materialize(repeated_filter(own, self.blocks), "bloom") for own in dealt]

    def _dealt(self, rows: DataFrame) -> list[DataFrame]:
        """rows by ranges: written in folders, so that each is read for itself; none is shuffled for that."""
        if self.ranges == 1:
            return [rows]
        written = materialize(rows.withColumn("_range", _range(F.col("sha"), self.ranges)), "ranges", ["_range"])
        return [written.where(F.col("_range") == r).drop("_range") for r in range(self.ranges)]

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that may share their sha, rows that do not)."""
        parts = [_split(own, bloom, self.blocks) for own, bloom in zip(self._dealt(rows), self.blooms)]
        maybe, single = (reduce(DataFrame.union, half) for half in zip(*parts))
        return maybe, single


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is empty; the largest id of equal
    texts stays. Rows that repeat both id and text count each and get the same answer. A null id is
    below every id: such a row is kept only where its text has no row with an id (keep_id null).
    Other columns are not read. An empty table gives an empty result.
    """
    hashes = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalized(F.col(text_col)), 256).alias("sha")), "hashes"
    )
    n = hashes.count()
    maybe, single = Filters(hashes, n).split(hashes)
    groups = materialize(maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    many = F.col("group_size") > max(HOT_ROWS, n // HOT_TEXTS)
    # Texts of very many rows, fewer than HOT_TEXTS, meet their rows where these are.
    hot = groups.where(many).withColumnRenamed("sha", "_sha")
    tried = maybe.join(F.broadcast(hot), F.col("sha") == F.col("_sha"), "left")
    rest = tried.where("_sha IS NULL").select("doc_id", "sha").join(groups.where(~many), "sha")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"]
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return tried.where("_sha IS NOT NULL").select(*columns).union(rest.select(*columns)).union(alone).withColumnRenamed("sha", "text_sha256")


def keep_largest(docs: DataFrame) -> DataFrame:
    """docs without exact duplicates: of equal texts the row with the largest doc_id stays.

    Of rows that repeat id and text one stays. Columns are those of docs, whatever their names.
    """
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    doc_id, text = names["doc_id"], names["text"]
    rows = inner.withColumn("sha", F.sha2(normalized(F.col(text)), 256))
    hashes = materialize(rows.select("sha", F.col(doc_id).alias("doc_id")), "hashes")
    filters = Filters(hashes, hashes.count())
    maybe, single = filters.split(rows)
    narrow, _ = filters.split(hashes)
    # Who stays is found on hashes and ids; the id is part of the key by which texts move, so the
    # copies of one text are not drawn together.
    keep = narrow.groupBy("sha").agg(F.max("doc_id").alias("_keep")).withColumnRenamed("sha", "_sha")
    first = maybe.join(keep, (F.col("sha") == F.col("_sha")) & F.col(doc_id).eqNullSafe(F.col("_keep")), "left_semi")
    return first.dropDuplicates(["sha"]).union(single).drop("sha").toDF(*docs.columns)
