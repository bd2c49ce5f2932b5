"""A search index in files: chunks, postings by term, and sums of the fields' statistics.

Every change is a numbered batch of files and counts once its number stands among the commits. A chunk
that is written again or deleted is noted with the number up to which it is gone, so nothing is
rewritten; `compacted` makes a fresh index of what is left. A commit names the batches of which any chunk
is left, and no other is read. Postings are sorted by term within ranges of terms: a query reads the row
groups of its terms. Texts are tokenized once, when their batch is written: the number of terms of each
field of a chunk is kept. Statistics are sums to which a batch adds what it brings and takes away, so a
query does not read the whole index for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import search as S

CHUNK = "chunk_id long, doc_id long, filename string, title string, memo string, text string, page_num long, chunk_idx int, embedding array<float>"
POSTING = "chunk_id long, doc_id long, field string, dl long, term string, tf long"
#: Ranges of terms in a batch at least, terms that a range has at most where they are many, and chunks of a file.
RANGES, RANGE_TERMS, FILE_CHUNKS = 32, 2_000_000, 50_000
SIZE = "chunk_id long, field string, dl long"
COMMIT = "number long, ended long, live array<long>"
#: So many chunks that are gone are sent to all tasks that read; more are met by a shuffle.
SENT = 2_000_000


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = tuple(S.FIELDS), tokenize=S.terms):
        self.spark, self.path, self.fields, self.tokenize = spark, path.rstrip("/"), fields, tokenize

    # ---- writing ----------------------------------------------------------------------------------

    def add(self, rows: DataFrame) -> tuple[int, int]:
        """(rows taken, rows refused): chunks, in place of those with the same chunk_id. A row without
        chunk_id or doc_id is refused; of rows with one chunk_id one is taken. A missing embedding is
        allowed: such a chunk is found by its words only."""
        named = {f.split(" ")[0]: f.split(" ", 1)[1] for f in CHUNK.split(", ")}
        rows = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in named.items()])
        n = self._next()
        # Rows may be dear to make, and a shuffle by ranges looks at its input twice: they are made once.
        held = f"{self.path}/taking/batch={n}"
        rows.write.mode("overwrite").parquet(held)
        given = self.spark.read.schema(CHUNK).parquet(held)
        all_rows = given.count()
        fit = given.where("chunk_id IS NOT NULL AND doc_id IS NOT NULL")
        # In ranges of ids, by which equal ones meet: who asks for a page of results reads the row groups of its chunks.
        files = -(-all_rows // FILE_CHUNKS)
        dealt = fit.repartitionByRange(files, "chunk_id") if files > RANGES else fit.repartitionByRange("chunk_id")
        dealt.dropDuplicates(["chunk_id"]).sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{self.path}/chunks/batch={n}")
        self._drop(held)
        own = self.spark.read.schema(CHUNK).parquet(f"{self.path}/chunks/batch={n}")
        # Tokens are counted once: sums, bounds of ranges and rows are read from their counts.
        counting = f"{self.path}/counting/batch={n}"
        S.term_counts(own, self.fields, self.tokenize).write.mode("overwrite").parquet(counting)
        counts = self.spark.read.schema(S.COUNTED).parquet(counting)
        counts.select("chunk_id", "field", "dl").write.mode("overwrite").parquet(f"{self.path}/sizes/batch={n}")
        added = self._sums(counts, 1).collect()  # a row for each field
        # So many ranges that none has more rows than a task sorts in memory. A term of many chunks has several.
        ranges = max(RANGES, -(-sum(r["total"] for r in added) // RANGE_TERMS))
        S.posted(counts).repartitionByRange(ranges, "term", "field", "chunk_id").sortWithinPartitions("term", "field", "chunk_id").write.mode("overwrite").parquet(f"{self.path}/postings/batch={n}")
        self._drop(counting)
        self._close(n, added, self._end(n, own.select("chunk_id")))
        taken = own.count()
        return taken, all_rows - taken

    def delete(self, doc_ids: DataFrame) -> int:
        """How many chunks of doc_ids (doc_id) went."""
        n = self._next()
        gone = self.chunks().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        count = self._end(n, gone.select("chunk_id"))
        if count:
            self._close(n, [], count)
        return count

    def replace(self, rows: DataFrame) -> tuple[int, int]:
        """add, in place of all chunks of the same documents."""
        self.delete(rows.where("doc_id IS NOT NULL").select("doc_id"))
        return self.add(rows)

    def compacted(self, path: str) -> SearchIndex:
        """A fresh index under path with the chunks that are there now."""
        out = SearchIndex(self.spark, path, self.fields, self.tokenize)
        out.add(self.chunks())
        return out

    def _next(self) -> int:
        return max(self._batches(), default=0) + 1

    def _end(self, n: int, ids: DataFrame) -> int:
        """Note which chunks of ids (chunk_id) batch n puts an end to, and give their number."""
        ended = ids.join(self.chunks().select("chunk_id"), "chunk_id", "left_semi") if n > 1 else ids.limit(0)
        ended.withColumn("before", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{self.path}/gone/batch={n}")
        return self._ended(n).count()

    def _ended(self, n: int) -> DataFrame:
        return self.spark.read.schema("chunk_id long, before long").parquet(f"{self.path}/gone/batch={n}")

    def _close(self, n: int, added: list, ended: int) -> None:
        """Note what batch n adds to the sums and takes away, and that it counts."""
        sums = self.spark.createDataFrame(added, "field string, n long, total long")
        if n > 1:
            sums = sums.union(self._sums(self._live("sizes", SIZE).join(self._ended(n), "chunk_id", "left_semi"), -1))
        sums.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sums/batch={n}")
        live = [n]
        if n > 1:
            done, gone = self._commits()
            left = self._left("chunks", "chunk_id long", [*done, n], gone | {n: ended})
            live = sorted(r["batch"] for r in left.select("batch").distinct().collect())
        self.spark.createDataFrame([(n, ended, live)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={n}")

    def _drop(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _sums(self, sizes: DataFrame, sign: int) -> DataFrame:
        """field, n, total of sizes (field, dl): chunks with terms and their number of terms."""
        return sizes.groupBy("field").agg((F.count("*") * sign).alias("n"), (F.sum("dl") * sign).alias("total"))

    # ---- reading ----------------------------------------------------------------------------------

    def _batches(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        system = folder.getFileSystem(conf)
        if not system.exists(folder):
            return []
        done = (s.getPath() for s in system.listStatus(folder) if s.isDirectory())
        return [int(p.getName().split("=")[1]) for p in done if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _read(self, part: str, schema: str, batches: list[int]) -> DataFrame:
        whole = self.spark.read.schema(schema + ", batch long").parquet(f"{self.path}/{part}")
        return whole.where(F.col("batch").isin(batches))

    def _commits(self) -> tuple[list[int], dict[int, int]]:
        """The batches of which any chunk is left, and how many chunks each batch put an end to."""
        batches = self._batches()
        if len(batches) < 2:
            return batches, {}
        rows = self._read("commits", COMMIT, batches).orderBy("number").collect()  # a row for each batch
        return rows[-1]["live"], {r["number"]: r["ended"] for r in rows}

    def _left(self, part: str, schema: str, batches: list[int], ended: dict[int, int]) -> DataFrame:
        """What batches wrote of a part, without chunks that a later one of ended put an end to; with batch."""
        rows = self._read(part, schema, batches)
        later = {n: many for n, many in ended.items() if many and n > min(batches, default=n)}
        if not later:
            return rows
        gone = self._read("gone", "chunk_id long, before long", list(later)).groupBy(F.col("chunk_id").alias("_gone")).agg(F.max("before").alias("_before"))
        gone = F.broadcast(gone) if sum(later.values()) <= SENT else gone
        return rows.join(gone, (F.col("chunk_id") == F.col("_gone")) & (F.col("batch") < F.col("_before")), "left_anti")

    def _live(self, part: str, schema: str) -> DataFrame:
        if not self._batches():
            raise S.IndexUnavailable(f"no index under {self.path}")
        return self._left(part, schema, *self._commits()).drop("batch")

    def chunks(self) -> DataFrame:
        return self._live("chunks", CHUNK)

    def postings(self) -> DataFrame:
        return self._live("postings", POSTING)

    def stats(self) -> DataFrame:
        """field, n, avgdl, as field_stats has them."""
        sums = self._read("sums", "field string, n long, total long", self._batches()).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return sums.where("n > 0").select("field", "n", (F.col("total") / F.col("n")).alias("avgdl"))

    def committed(self) -> bool:
        """Whether any batch counts."""
        return bool(self._batches())

    def count(self) -> int:
        """Chunks that are there; none where there is no index yet."""
        return self.chunks().count() if self._batches() else 0
