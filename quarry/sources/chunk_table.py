"""Chunks in a table that is partitioned by parts of documents and bucketed by document.

A document that is parsed again is replaced by writing over its part alone, and a join with another table
bucketed alike needs no shuffle: both sides are read bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that a replacement writes over, and buckets that a join reads.
PARTS, BUCKETS = 32, 16
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def part_of(doc_id="doc_id", parts: int = PARTS):
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int")


class ChunkTable:
    def __init__(self, spark: SparkSession, name: str, path: str, parts: int = PARTS, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.parts, self.buckets = spark, name, path.rstrip("/"), parts, buckets

    def create(self, rows: DataFrame) -> ChunkTable:
        """The table of rows (doc_id, ...), in place of what has its name."""
        self.save(rows.withColumn("part", part_of(parts=self.parts)), self.name, "chunks", ["part"])
        return self

    def save(self, rows: DataFrame, name: str, folder: str, by: list[str] | None = None) -> None:
        """A table bucketed by doc_id as the chunks are, one file for each bucket and partition."""
        dealt = rows.repartition(self.buckets, "doc_id")
        writer = dealt.write.mode("overwrite").option("path", f"{self.path}/{folder}").bucketBy(self.buckets, "doc_id").sortBy("doc_id")
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)

    def chunks(self) -> DataFrame:
        return self.spark.table(self.name)

    def replace(self, doc_ids: DataFrame, rows: DataFrame) -> None:
        """Rows in place of all chunks of doc_ids (doc_id) and of the documents that rows has; documents
        without rows are deleted. Parts without any of them are neither read nor written."""
        gone = doc_ids.select("doc_id").union(rows.select("doc_id")).where("doc_id IS NOT NULL").distinct()
        parts = [r[0] for r in gone.select(part_of(parts=self.parts).alias("part")).distinct().orderBy("part").collect()]  # at most `parts`
        if not parts:
            return
        columns = self.chunks().columns
        stay = self.chunks().where(F.col("part").isin(parts)).join(gone, "doc_id", "left_anti").select(*columns)
        after = stay.unionByName(rows.withColumn("part", part_of(parts=self.parts)).select(*columns))
        # Where a part loses its last chunk nothing is written over it: such parts are dropped.
        held = f"{self.path}/replacing"
        after.repartition(self.buckets, "doc_id").write.mode("overwrite").parquet(held)
        ready = self.spark.read.schema(after.schema).parquet(held)
        left = {r[0] for r in ready.select("part").distinct().collect()}
        mode = self.spark.conf.get(_OVERWRITE)
        self.spark.conf.set(_OVERWRITE, "dynamic")  # an insert into a table takes it from the session alone
        try:
            ready.repartition(self.buckets, "doc_id").write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(_OVERWRITE, mode)
        for part in set(parts) - left:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (part = {part})")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/chunks/part={part}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.spark.catalog.refreshTable(self.name)
