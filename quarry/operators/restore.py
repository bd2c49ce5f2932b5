"""Restoring deleted documents with all that belonged to them, and inserting uploads without taking
anything's place: each is one plan that gives the tables as they are afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import or_else
from quarry.functions.vectors import from_text, to_text
from quarry.operators import lifecycle as L
from quarry.operators.admin import inherited
from quarry.sources.files import safe_path

CHUNK_COLUMNS = ("doc_id", "chunk_idx", "page_num", "text", "embedding")
CHILDREN = {"comments": ("id", "user_email", "content"), "bookmarks": ("user_email", "created_at"), "permissions": ("user_email",)}


def trash_chunks(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks of deleted documents (gone: id) as they lie in the trash, vectors as base64 text."""
    kept = chunks.join(gone.select(F.col("id").alias("_gone")), F.col("doc_id") == F.col("_gone"), "left_semi")
    return kept.select("doc_id", "chunk_idx", "page_num", "text", to_text(F.col("embedding")).alias("embedding"))


def _beside(path: Column, mark: Column) -> Column:
    """path with a mark before its extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), mark, F.regexp_extract(path, r"(\.[^./]*)$", 1))


def restore(wanted: DataFrame, logs: DataFrame, chunks_kept: DataFrame, tables: dict[str, DataFrame], as_of: str, by: str, path: str = "saved_path", held_at: str | None = None) -> dict[str, DataFrame]:
    """verdicts, documents, comments, bookmarks, permissions, chunks, logs after restoring wanted (id of a
    log) whose verdict is 200; tables has documents and their children as they are.

    A document gets its old id, or a new one where that is taken, and its old path, or one with
    _restored_ and the log's id where another document has that. What is left of children under the id
    is replaced by what the snapshot has, vectors come back from their bytes, and the log is closed
    without its snapshot. Of several logs of one document in a call the newest is restored and the
    others get 409. What is restored is read for every table: it is written under held_at, a fresh folder
    that driver and executors share, where that is given, and the plans of the tables begin there.
    """
    docs = tables["documents"]
    asked = L.restore_verdict(wanted.select("id").distinct(), logs, as_of)
    held = logs.select(F.col("id").alias("_log"), "doc_id", "deleted_at")
    joined = asked.join(held, F.col("id") == F.col("_log"), "left")
    newest = Window.partitionBy("doc_id").orderBy(F.desc(F.col("verdict") == 200), F.desc("deleted_at"), F.desc("id"))
    twice = (F.col("verdict") == 200) & (F.row_number().over(newest) > 1)
    joined = joined.withColumn("verdict", F.when(twice, 409).otherwise(F.col("verdict")))
    good = joined.where("verdict = 200").select(F.col("id").alias("log_id"), "doc_id")
    good = good.join(L.restored_ids(good.select("doc_id"), docs), "doc_id")
    # Snapshots hold whole documents: only those of what is restored are read on.
    good = good.join(logs.select(F.col("id").alias("log_id"), "snapshot"), "log_id")
    if held_at:
        good.write.parquet(held_at)
        good = good.sparkSession.read.schema(good.schema).parquet(held_at)
    else:
        good = good.persist()  # a lost part of it is made again from the logs

    back = L.from_snapshot(good.select("doc_id", "snapshot"), docs.schema).withColumnRenamed("id", "_old")
    back = back.join(good.select("log_id", F.col("doc_id").alias("_old"), F.col("restored_id").alias("id")), "_old").drop("_old")
    taken = docs.select(F.col(path).alias("_taken")).distinct()
    clash = F.concat(F.lit("_restored_"), F.col("log_id").cast("string"))
    back = back.join(taken, F.col(path) == F.col("_taken"), "left")
    back = back.withColumn(path, F.when(F.col("_taken").isNotNull(), _beside(F.col(path), clash)).otherwise(F.col(path)))
    after = {"verdicts": joined.select("id", "verdict"), "documents": docs.unionByName(back.select(*docs.columns))}

    placed = good.select("doc_id", "restored_id")
    for name, columns in CHILDREN.items():
        left = tables[name].join(placed.select(F.col("restored_id").alias("doc_id")), "doc_id", "left_anti")
        own = L.from_snapshot(good.select("doc_id", "snapshot"), docs.schema, name).join(placed, "doc_id").drop("doc_id").withColumnRenamed("restored_id", "doc_id")
        after[name] = left.unionByName(own.select("doc_id", *columns), allowMissingColumns=True)
    own = chunks_kept.join(placed, "doc_id").drop("doc_id").withColumnRenamed("restored_id", "doc_id").withColumn("embedding", from_text(F.col("embedding")))
    left = tables["chunks"].join(placed.select(F.col("restored_id").alias("doc_id")), "doc_id", "left_anti")
    after["chunks"] = left.unionByName(own.select(*CHUNK_COLUMNS), allowMissingColumns=True)

    closed = good.select(F.col("log_id").alias("_log"), F.col("restored_id").alias("_as"))
    done = logs.join(closed, F.col("id") == F.col("_log"), "left")
    shut = F.col("_log").isNotNull()
    after["logs"] = done.withColumns(
        {
            "status": F.when(shut, "restored").otherwise(F.col("status")),
            "snapshot": F.when(~shut, F.col("snapshot")),
            "restored_at": F.when(shut, L.as_of_lit(as_of)),
            "restored_by": F.when(shut, F.lit(by)),
            "restored_doc_id": F.col("_as"),
        }
    ).drop("_log", "_as")
    return after


def insert_uploads(uploads: DataFrame, docs: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """The new rows of documents for uploads (id, filename, original_path, sha256, uploaded_by, ...): being
    parsed, in their uploader's department, with duplicate_of, the newest document with the same bytes,
    and saved_path, never one that a document has: (2), (3) and so on follow those that are there."""
    same = docs.where("sha256 IS NOT NULL").groupBy(F.col("sha256").alias("_sha")).agg(F.max_by("id", F.struct("uploaded_at", "id")).alias("duplicate_of"))
    rows = inherited(uploads, users, as_of).join(same, F.col("sha256") == F.col("_sha"), "left").drop("_sha")
    place = lambda: safe_path(or_else(F.col("original_path"), F.col("filename")))
    rows = rows.withColumn("_p", place())
    held = docs.select(place().alias("_held")).groupBy("_held").agg(F.count("*").alias("_n"))
    # Uploads with one path are numbered from a count of those before them, range by range of ids.
    ranged = rows.withColumn("_range", F.floor(F.col("id") / L.ID_RANGE))
    before = Window.partitionBy("_p").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p", "_range").agg(F.count("*").alias("_c")).select("_p", "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    k = F.row_number().over(Window.partitionBy("_p", "_range").orderBy("id"))
    numbered = ranged.withColumn("_k", k).join(starts, ["_p", "_range"]).join(held, F.col("_p") == F.col("_held"), "left")
    n = F.coalesce("_n", F.lit(0)) + F.col("_before") + F.col("_k")
    saved = F.when(n == 1, F.col("_p")).otherwise(_beside(F.col("_p"), F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))))
    return numbered.withColumn("saved_path", saved).drop("_p", "_range", "_k", "_before", "_held", "_n")


def category_verdicts(docs: DataFrame, names: DataFrame) -> DataFrame:
    """name, verdict for names (name) of categories to delete: 409 while any document has it, else 200."""
    used = docs.groupBy(F.col("category").alias("_used")).agg(F.count("*").alias("_n"))
    joined = names.select("name").distinct().join(used, F.col("name") == F.col("_used"), "left")
    return joined.select("name", F.when(F.col("_n") > 0, 409).otherwise(200).alias("verdict"))
