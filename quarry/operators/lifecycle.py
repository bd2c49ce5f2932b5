"""Changes as plans: an append-only change log and the state it gives, trash, restore, retention.

Parquet tables know no MERGE or DELETE, so every change is a new row or a rewritten snapshot, and
a reader takes the latest row of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import or_else, shift
from quarry.operators.documents import without_keys

TRASH_DAYS = 30
LOG_DAYS = 90
SESSION_DAYS = 7
MIRROR_DAYS = 3
STALE_MINUTES = 10
HEAL_RATIO = 0.9
BACKUPS_KEPT = 14


def as_of_lit(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def latest_state(log: DataFrame, key: list[str], version: list[Column], deleted: str | None = None) -> DataFrame:
    """The last row of each key in a change log, without keys whose last row is a deletion."""
    w = Window.partitionBy(*key).orderBy(*version)
    out = log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out.where(~F.col(deleted)).drop(deleted) if deleted else out


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with the same key. One row of changes for a key."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def insert_absent(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """base and those rows whose key it has not, once each."""
    return base.unionByName(rows.dropDuplicates(key).join(base.select(*key), key, "left_anti"))


def set_where(df: DataFrame, which: Column, **values: Column) -> DataFrame:
    """Bulk update: new values where a condition holds."""
    return df.withColumns({k: F.when(which, v).otherwise(F.col(k)) for k, v in values.items()})


def stale_to_failed(docs: DataFrame, as_of: str, minutes: int = STALE_MINUTES) -> DataFrame:
    """Documents that have been parsing for too long become failed."""
    late = (F.col("status") == "parsing") & (F.col("updated_at") < shift(as_of_lit(as_of), minutes=-minutes))
    return set_where(docs, late, status=F.lit("failed"))


def purge_logs(logs: DataFrame, as_of: str) -> DataFrame:
    """Deletion logs after a sweep: trash past its days is purged and loses its snapshot, entries past
    theirs are gone."""
    age = lambda d: shift(as_of_lit(as_of), days=-d)
    kept = logs.where(F.col("deleted_at") >= age(LOG_DAYS))
    late = (F.col("status") == "trashed") & (F.col("deleted_at") < age(TRASH_DAYS))
    values = {"status": F.lit("purged")} | ({"snapshot": F.lit(None).cast("string")} if "snapshot" in logs.columns else {})
    return set_where(kept, late, **values)


def log_states(logs: DataFrame, as_of: str) -> DataFrame:
    """What a deletion log shows: state, and until when a trashed document can be restored. Trash whose
    time is over counts as purged already."""
    until = shift(F.col("deleted_at"), days=TRASH_DAYS)
    open_ = (F.col("status") == "trashed") & (until > as_of_lit(as_of))
    state = F.when((F.col("status") == "trashed") & ~open_, "purged").otherwise(or_else(F.col("status"), F.lit("legacy")))
    return logs.select("id", "doc_id", "filename", "deleted_at", state.alias("state"), F.when(open_, until).alias("restorable_until"))


def restore_verdict(wanted: DataFrame, logs: DataFrame, as_of: str) -> DataFrame:
    """The answer to each restore (wanted: id of a log): 404 without a log, 409 when restored already,
    410 when it is not in the trash, its snapshot or folder is missing or its time is over, else 200."""
    gone = (or_else(F.col("snapshot"), F.lit(None)).isNull()) | (or_else(F.col("trash_dir"), F.lit(None)).isNull())
    # Whether there is a snapshot goes into the join, not the snapshot.
    held = logs.select(F.col("id").alias("_id"), "status", "deleted_at", gone.alias("_gone"))
    late = shift(F.col("deleted_at"), days=TRASH_DAYS) <= as_of_lit(as_of)
    verdict = (
        F.when(F.col("_id").isNull(), 404)
        .when(F.col("status") == "restored", 409)
        .when(~F.col("status").eqNullSafe(F.lit("trashed")) | F.col("_gone") | late, 410)
        .otherwise(200)
    )
    return wanted.join(held, wanted.id == F.col("_id"), "left").select("id", verdict.alias("verdict"))


#: Ids that are numbered together when conflicts get new ones.
ID_RANGE = 100_000


def restored_ids(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, restored_id: the old id, or where it is taken the next free ones in order.

    Conflicts are numbered within ranges of ids; only a count for each range stands in one place.
    """
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    taken = docs.select(F.col("id").alias("_taken"))
    marked = wanted.join(taken, wanted.doc_id == taken._taken, "left").withColumn("_new", F.col("_taken").isNotNull())
    fresh = marked.where("_new").withColumn("_range", F.floor(F.col("doc_id") / ID_RANGE))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = fresh.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy("doc_id"))).join(starts, "_range")
    fresh = numbered.join(F.broadcast(top)).select("doc_id", (F.col("_top") + F.col("_before") + F.col("_k")).alias("restored_id"))
    return marked.where("NOT _new").select("doc_id", F.col("doc_id").alias("restored_id")).unionByName(fresh)


def sweep(rows: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows that a sweep leaves: those not older than so many days (revoked sessions SESSION_DAYS,
    mirrored trash MIRROR_DAYS)."""
    return rows.where(F.col(at) >= shift(as_of_lit(as_of), days=-days))


def cascade(children: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Child tables without the rows of deleted documents (gone: id)."""
    return {name: without_keys(df, gone, key, "id") for name, df in children.items()}


def trash_snapshot(docs: DataFrame, comments: DataFrame, bookmarks: DataFrame, permissions: DataFrame) -> DataFrame:
    """doc_id, snapshot: each document with its comments, bookmarks and grants as JSON."""

    def gather(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy(F.col("doc_id").alias(f"_{name}")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    out = docs
    for df, name, columns in ((comments, "comments", ("id", "user_email", "content")), (bookmarks, "bookmarks", ("user_email", "created_at")), (permissions, "permissions", ("user_email",))):
        part = gather(df, name, *columns)
        out = out.join(part, out.id == part[f"_{name}"], "left").drop(f"_{name}")
    body = F.struct(F.struct(*docs.columns).alias("document"), "comments", "bookmarks", "permissions")
    return out.select(F.col("id").alias("doc_id"), F.to_json(body).alias("snapshot"))


def from_snapshot(trash: DataFrame, docs_schema, part: str | None = None) -> DataFrame:
    """The documents, or one of their child tables, that snapshots hold."""
    columns = {"comments": "id bigint, user_email string, content string", "bookmarks": "user_email string, created_at timestamp_ntz", "permissions": "user_email string"}
    fields = ", ".join(f"{k}: array<struct<{', '.join(c.replace(' ', ': ') for c in v.split(', '))}>>" for k, v in columns.items())
    schema = f"struct<document: {docs_schema.simpleString()}, {fields}>"
    parsed = trash.select("doc_id", F.from_json("snapshot", schema).alias("s"))
    if part is None:
        return parsed.select("s.document.*")
    return parsed.select("doc_id", F.explode(f"s.{part}").alias("x")).select("doc_id", "x.*")


def needs_reindex(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Counts of both sides and whether the index lags; never when there is nothing to index."""
    both = chunks.agg(F.count("*").alias("db_count")).join(index.agg(F.count("*").alias("index_count")))
    return both.withColumn("reindex", (F.col("db_count") > 0) & (F.col("index_count") < HEAL_RATIO * F.col("db_count")))


def missing_from_index(chunks: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The chunks to add, for a repair that moves only what is missing."""
    return chunks.join(index.select(key), key, "left_anti")


def keep_newest(files: DataFrame, group: str, order: list[Column], n: int = BACKUPS_KEPT) -> DataFrame:
    """files with keep: whether a file is among the newest n of its group."""
    w = Window.partitionBy(group).orderBy(*order)
    return files.withColumn("keep", F.row_number().over(w) <= n)


def counters(base: DataFrame, events: DataFrame, name: str = "download_count") -> DataFrame:
    """base with the events of each id added to a counter; addition commutes, so order is free."""
    n = events.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n"))
    return base.join(n, base.id == n._d, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col("_n"), F.lit(0))).drop("_d", "_n")


def counts_as_download(method: Column, ranged: Column) -> Column:
    """Whether a request adds to the counter: a GET without a range, or of one from the first byte on."""
    return (F.upper(method) == "GET") & (F.coalesce(ranged, F.lit("")).rlike(r"^\s*$") | F.coalesce(ranged, F.lit("")).rlike(r"^bytes=0-"))


def log_rows(calls: DataFrame, as_of: str | None = None) -> DataFrame:
    """The search log's rows of calls (query, user_email, result_count): those with a query that is not
    blank, of anonymous where nobody is logged in; at as_of, or else at their own searched_at."""
    asked = calls.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    at = F.col("searched_at") if as_of is None else as_of_lit(as_of).alias("searched_at")
    return asked.select("query", F.coalesce("user_email", F.lit("anonymous")).alias("user_email"), "result_count", at)
