"""Filters, access rules, joins and aggregates over the document tables.

All are plan builders: they take and return DataFrames, run nothing, and leave physical choices to
the optimizer. Sorting always ends in an id, so equal keys have one order.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import contains_ignoring_case, or_else, shift, strip

FIXED_CATEGORIES = ("spec", "research", "presentation", "report", "other")


def _day(text: str | None) -> datetime | None:
    try:
        return datetime.strptime(text, "%Y-%m-%d") if text else None
    except ValueError:
        return None


def visible(docs: DataFrame, category: str | None = None, uploaded_by: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Parsed documents, by optional category, uploader and days; a day that can't be read is ignored.
    All conditions are plain comparisons that reach the scan."""
    out = docs.where(F.col("status") == "success")
    if category:
        out = out.where(F.col("category") == category)
    if uploaded_by:
        out = out.where(F.col("uploaded_by") == uploaded_by)
    if first := _day(date_from):
        out = out.where(F.col("uploaded_at") >= F.lit(first).cast("timestamp_ntz"))
    if last := _day(date_to):
        out = out.where(F.col("uploaded_at") < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))
    return out


def newest(docs: DataFrame, limit: int) -> DataFrame:
    return docs.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(limit)


def browse_rows(docs: DataFrame) -> DataFrame:
    """What a list shows: the title or else the filename as snippet, and the first 150 characters."""
    return docs.select(
        F.col("id").alias("doc_id"),
        "filename",
        "category",
        F.col("page_count").alias("pages"),
        or_else(F.col("title"), F.col("filename")).alias("snippet"),
        strip(F.substring("text", 1, 150)).alias("content_preview"),
        F.lit(0).alias("page_num"),
        F.lit(0).alias("score"),
        "download_count",
        "uploaded_by",
        "uploaded_at",
    )


def by_filename(docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return browse_rows(newest(docs.where(contains_ignoring_case(F.col("filename"), query.strip())), limit))


def browse(docs: DataFrame, limit: int = 200) -> DataFrame:
    return browse_rows(newest(docs, limit))


def readable(docs: DataFrame, permissions: DataFrame, user: str | None, department: str | None, admin: bool = False) -> DataFrame:
    """Rows of docs that a user may read.

    Admins read all. A document of a department is for its members and for those it is granted to;
    one without a department is for all unless it is granted to some, and then for these.
    """
    if admin:
        return docs
    granted = permissions.where(F.col("user_email") == user).select(F.col("doc_id").alias("_granted")).distinct()
    limited = permissions.select(F.col("doc_id").alias("_limited")).distinct()
    joined = docs.join(granted, docs.id == granted._granted, "left").join(limited, docs.id == limited._limited, "left")
    own = F.nullif(F.col("department"), F.lit(""))
    same = F.coalesce(own == F.lit(department), F.lit(False))
    allowed = F.col("_granted").isNotNull() | F.when(own.isNotNull(), same).otherwise(F.col("_limited").isNull())
    return joined.where(allowed).drop("_granted", "_limited")


def recent(docs: DataFrame, permissions: DataFrame, user: str, department: str | None, limit: int = 10) -> DataFrame:
    """The newest readable documents among the newest 2 * limit: the first cut comes before access."""
    return newest(readable(newest(visible(docs), 2 * limit), permissions, user, department), limit)


def admin_list(docs: DataFrame, text: str = "", category: str | None = None, status: str | None = None, file_type: str | None = None) -> DataFrame:
    out = docs.where(contains_ignoring_case(F.col("filename"), text)) if text else docs
    for name, value in (("category", category), ("status", status), ("file_type", file_type)):
        if value:
            out = out.where(F.col(name) == value)
    return out


def needs_review(docs: DataFrame) -> DataFrame:
    return docs.where((F.col("status") == "failed") | F.col("has_flagged"))


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The page-th page, from 1, of df in that order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def latest_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in that order; rows without a key are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest_duplicate(docs: DataFrame) -> DataFrame:
    """id, duplicate_of: the newest other document with the same content hash.

    Map tasks keep two rows of a hash, so the window holds no more than that many of each.
    """
    held = docs.where(F.col("sha256").isNotNull()).select("id", "sha256", "uploaded_at")
    w = Window.partitionBy("sha256").orderBy(F.desc("uploaded_at"), F.desc("id"))
    two = held.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    best = two.groupBy("sha256").agg(F.max(F.when(F.col("_n") == 1, F.col("id"))).alias("_first"), F.max(F.when(F.col("_n") == 2, F.col("id"))).alias("_second"))
    other = F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    return held.join(best.where("_second IS NOT NULL"), "sha256").select("id", other.alias("duplicate_of"))


def display_name(df: DataFrame, users: DataFrame, email: str, out: str) -> DataFrame:
    """Adds the user's name, or the address where there is none; null for nobody and 'anonymous'."""
    names = users.select(F.col("email").alias("_email"), F.col("name").alias("_name"))
    who = F.col(email)
    shown = F.when(who.isNull() | (who == "anonymous"), F.lit(None)).otherwise(or_else(F.col("_name"), who))
    return df.join(names, who == F.col("_email"), "left").withColumn(out, shown).drop("_email", "_name")


def bookmarks_of(bookmarks: DataFrame, docs: DataFrame, user: str) -> DataFrame:
    own = bookmarks.where(F.col("user_email") == user)
    return own.join(docs, own.doc_id == docs.id).select("doc_id", "filename", "category", F.col("created_at").alias("bookmarked_at"))


def notification_rows(notes: DataFrame, docs: DataFrame, comments: DataFrame, recipient: str, limit: int = 50) -> DataFrame:
    """The newest notifications of a user whose document is there, with the comment or else the message."""
    own = notes.where(F.col("recipient") == recipient)
    said = comments.select(F.col("id").alias("_cid"), "content")
    joined = own.join(docs.select(F.col("id").alias("_did"), "filename", "title"), F.col("doc_id") == F.col("_did"))
    joined = joined.join(said, F.col("comment_id") == F.col("_cid"), "left")
    return (
        joined.orderBy(F.desc("created_at"), F.desc("id"))
        .limit(limit)
        .select("id", "doc_id", or_else(F.col("title"), F.col("filename")).alias("doc_label"), F.coalesce("content", "message").alias("body"), "is_read", "created_at")
    )


def fan_out(comments: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """A notification for the uploader of each commented document, but not to oneself or to nobody: who
    commented on what, and the first 80 characters."""
    up = docs.select(F.col("id").alias("_did"), "uploaded_by", "title", "filename")
    ok = F.col("uploaded_by").isNotNull() & (F.col("uploaded_by") != "") & (F.col("uploaded_by") != "anonymous") & ~F.col("uploaded_by").eqNullSafe(F.col("user_email"))
    named = display_name(comments, users, "user_email", "_who").join(up, F.col("doc_id") == F.col("_did")).where(ok)
    label = or_else(F.col("title"), F.col("filename"))
    said = F.concat(F.coalesce("_who", "user_email"), F.lit("님이 '"), label, F.lit("' 문서에 댓글을 남겼습니다: "), F.substring("content", 1, 80))
    return named.select(F.col("id").alias("comment_id"), "doc_id", F.col("uploaded_by").alias("recipient"), said.alias("message"))


def statuses(docs: DataFrame, chunks: DataFrame, id_list: str) -> DataFrame:
    """Status and chunk count of the ids in a comma list; what is no number in it is ignored."""
    ids = [int(x) for x in (p.strip() for p in id_list.split(",")) if x.isdecimal()]
    count = chunks.where(F.col("doc_id").isin(ids)).groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n"))
    return docs.where(F.col("id").isin(ids)).join(count, F.col("id") == F.col("_d"), "left").select("id", "status", F.coalesce("_n", F.lit(0)).cast("long").alias("chunk_count"))


def without_keys(df: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """Rows of df whose key is not in gone: blacklists, cascades, conflicts."""
    return df.join(gone.select(F.col(gone_key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def overview(docs: DataFrame) -> DataFrame:
    """Counts of all, flagged and failed documents in one pass."""
    return docs.agg(
        F.count("*").alias("total"), F.count_if("has_flagged").alias("flagged"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "success").alias("succeeded")
    )


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("n"))


def type_shares(docs: DataFrame, category: str | None = None) -> DataFrame:
    """Documents of each file type in a category and their rounded percentage."""
    scope = docs.where(F.col("category") == category) if category else docs
    n = scope.groupBy(F.coalesce("file_type", F.lit("unknown")).alias("file_type")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 0).cast("long"))


def top_queries(logs: DataFrame, limit: int = 5) -> DataFrame:
    return logs.where(F.trim(F.coalesce("query", F.lit(""))) != "").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit)


def search_history(logs: DataFrame, user: str, limit: int = 10) -> DataFrame:
    """A user's latest different queries, newest first."""
    own = logs.where((F.col("user_email") == user) & (F.trim(F.coalesce("query", F.lit(""))) != ""))
    return own.groupBy("query").agg(F.max("searched_at").alias("last_at")).orderBy(F.desc("last_at"), "query").limit(limit)


def daily_trend(df: DataFrame, at: str, as_of: str, days: int = 7) -> DataFrame:
    """Rows of each of the last days with zeros, and the largest count, 1 at least, for scaling.
    The last second of a day ends it: what comes after its whole second is not counted."""
    last = F.to_date(F.lit(as_of))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last, F.expr("INTERVAL 1 DAY"))).alias("day"))
    inside = df.where((F.to_date(at) >= F.date_sub(last, days - 1)) & (F.to_date(at) <= last))
    inside = inside.where(F.col(at) <= shift(F.to_date(at).cast("timestamp_ntz"), seconds=86399))
    per = inside.groupBy(F.to_date(at).alias("_day")).agg(F.count("*").alias("_n"))
    out = spine.join(per, spine.day == per._day, "left").select("day", F.date_format("day", "MM/dd").alias("label"), F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("scale", F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1)))


def categories(docs: DataFrame) -> DataFrame:
    """The fixed categories in their order, then others that occur by name."""
    fixed = docs.sparkSession.createDataFrame([(c, i) for i, c in enumerate(FIXED_CATEGORIES)], "category string, place int")
    seen = docs.where("category <> ''").select("category", F.lit(len(FIXED_CATEGORIES)).alias("place")).distinct()
    return fixed.unionByName(seen).groupBy("category").agg(F.min("place").alias("place"))


def uploaders(docs: DataFrame, users: DataFrame) -> DataFrame:
    who = docs.where(F.col("uploaded_by").isNotNull() & (F.col("uploaded_by") != "anonymous")).select(F.col("uploaded_by").alias("email")).distinct()
    return display_name(who, users, "email", "name")
