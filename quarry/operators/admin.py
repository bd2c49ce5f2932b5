"""What owners and administrators may do: roles, deletes with a verdict, edits, ordered lists.

A delete is a plan of two parts: a verdict for each request, and the table without the rows that
were granted. Requests are tables too, so one plan answers any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import contains_ignoring_case
from quarry.operators.lifecycle import as_of_lit

OK, BAD, FORBIDDEN, MISSING = 200, 400, 403, 404
CATEGORY_LENGTH = 30


# ---- roles ---------------------------------------------------------------------------------------------


def admin_set(fixed: list[str], table: DataFrame) -> DataFrame:
    """email of all administrators, lower-cased: those given by configuration and those of a table."""
    spark = table.sparkSession
    given = spark.createDataFrame([(e.strip().lower(),) for e in fixed if e.strip()], "email string")
    return given.union(table.select(F.lower("email"))).where("email IS NOT NULL").distinct()


def with_admin(df: DataFrame, email: str, admins: DataFrame, login: bool = True) -> DataFrame:
    """Adds is_admin. Without login everybody is an administrator, with it nobody without an address."""
    if not login:
        return df.withColumn("is_admin", F.lit(True))
    who = admins.select(F.lower("email").alias("_admin")).distinct()
    return df.join(who, F.lower(F.col(email)) == F.col("_admin"), "left").withColumn("is_admin", F.col("_admin").isNotNull()).drop("_admin")


def may_change(owner: Column, user: Column, admin: Column) -> Column:
    """Whether a user owns a row or is an administrator; nobody owns a row without an owner."""
    return admin | F.coalesce(owner == user, F.lit(False))


# ---- deletes -------------------------------------------------------------------------------------------


def comment_verdicts(requests: DataFrame, comments: DataFrame) -> DataFrame:
    """comment_id, user_email, verdict of requests (doc_id, comment_id, user_email, is_admin): 404 unless
    the document has that comment, 403 unless it is one's own or one is an administrator."""
    held = comments.select(F.col("id").alias("_id"), F.col("doc_id").alias("_doc"), F.col("user_email").alias("_owner"))
    joined = requests.join(held, (F.col("comment_id") == F.col("_id")) & (F.col("doc_id") == F.col("_doc")), "left")
    verdict = F.when(F.col("_id").isNull(), MISSING).when(~may_change(F.col("_owner"), F.col("user_email"), F.col("is_admin")), FORBIDDEN).otherwise(OK)
    return joined.select("comment_id", "user_email", verdict.alias("verdict"))


def notification_verdicts(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """id, recipient, verdict of requests (id, recipient): 404 unless it is a notification of one's own."""
    held = notes.select(F.col("id").alias("_id"), F.col("recipient").alias("_to"))
    joined = requests.join(held, (F.col("id") == F.col("_id")) & (F.col("recipient") == F.col("_to")), "left")
    return joined.select("id", "recipient", F.when(F.col("_id").isNull(), MISSING).otherwise(OK).alias("verdict"))


def user_verdicts(requests: DataFrame, admins: DataFrame) -> DataFrame:
    """email, verdict of requests (email) to remove users: 400 for administrators."""
    asked = requests.select(F.lower(F.trim("email")).alias("email")).distinct()
    return with_admin(asked, "email", admins).select("email", F.when(F.col("is_admin"), BAD).otherwise(OK).alias("verdict"))


def without_granted(df: DataFrame, key: str, verdicts: DataFrame, verdict_key: str) -> DataFrame:
    """df without the rows whose delete was granted."""
    gone = verdicts.where(F.col("verdict") == OK).select(F.col(verdict_key).alias("_gone")).distinct()
    return df.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def clear_history(logs: DataFrame, user: str) -> DataFrame:
    """Search logs without those of a user."""
    return logs.where(~F.col("user_email").eqNullSafe(F.lit(user)))


def bulk_delete(docs: DataFrame, wanted: DataFrame, reason: str, deleted_by: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(documents left, deletion logs) for wanted (doc_id). Ids that are not there are passed over, an id
    named twice counts once, and a reason is required."""
    if not reason.strip():
        raise ValueError("a deletion needs a reason")
    ids = wanted.select(F.col("doc_id").alias("_wanted")).distinct()
    gone = docs.join(ids, docs.id == F.col("_wanted"), "left_semi")
    log = gone.select(
        F.col("id").alias("doc_id"), "filename", "category", F.lit(deleted_by).alias("deleted_by"), F.lit(reason.strip()).alias("reason"),
        as_of_lit(as_of).alias("deleted_at"), F.lit("trashed").alias("status"),
    )
    return docs.join(ids, docs.id == F.col("_wanted"), "left_anti"), log


# ---- edits ---------------------------------------------------------------------------------------------


def edit_pages(parsed: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, pages, has_flagged, verdict of parsed (doc_id, pages) after edits (doc_id, page, text), one
    at most for a document: the first page of that number gets the text and is no longer flagged; 404
    where there is no such page. Documents without an edit are left out; the others are to be cut into
    chunks and indexed again."""
    joined = parsed.join(edits.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("text").alias("_text")), F.col("doc_id") == F.col("_doc"))
    at = F.array_position(F.transform("pages", lambda p: p["page"]), F.col("_page").cast("int"))
    flagged = lambda p: F.coalesce(p["flagged"], F.lit(False))
    new = F.transform(
        "pages",
        lambda p, i: F.when(i + 1 == at, p.withField("text", F.col("_text")).withField("flagged", F.lit(False))).otherwise(p),
    )
    out = joined.withColumn("pages", F.when(at > 0, new).otherwise(F.col("pages"))).withColumn("verdict", F.when(at > 0, OK).otherwise(MISSING))
    return out.select("doc_id", "pages", F.exists("pages", flagged).alias("has_flagged"), "verdict")


def inherited(uploads: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """New rows of documents for uploads (id, filename, uploaded_by, ...): being parsed, in their
    uploader's department."""
    home = users.select(F.col("email").alias("_email"), F.col("department").alias("department"))
    rows = uploads.drop("department").join(home, F.col("uploaded_by") == F.col("_email"), "left").drop("_email")
    return rows.withColumns({"status": F.lit("parsing"), "uploaded_at": as_of_lit(as_of), "updated_at": as_of_lit(as_of)})


def category_taken(categories: DataFrame, names: DataFrame) -> DataFrame:
    """name, taken for names (name): whether a category has that name, ignoring case, after cutting it to
    its length; a blank name counts as taken."""
    cut = F.substring(F.trim("name"), 1, CATEGORY_LENGTH)
    held = categories.select(F.lower("category").alias("_held")).distinct()
    joined = names.join(held, F.lower(cut) == F.col("_held"), "left")
    return joined.select("name", ((cut == "") | F.col("_held").isNotNull()).alias("taken"))


# ---- lists ---------------------------------------------------------------------------------------------


def uploader_matches(uploaders: DataFrame, text: str) -> DataFrame:
    """Uploaders (email, name) whose name or address contains text."""
    return uploaders.where(contains_ignoring_case(F.col("name"), text) | contains_ignoring_case(F.col("email"), text))


def result_order(by: str) -> list[Column]:
    """The order of a page of results: relevance as found, date newest first, author by name."""
    found = F.col("position")
    if by == "date":
        return [F.desc_nulls_last("uploaded_at"), found]
    if by == "author":
        return [F.coalesce("uploaded_by_name", "uploaded_by", F.lit("")), found]
    return [found]


def table_order(column: str, descending: bool = False) -> list[Column]:
    """The order of the administrators' table; a missing count is zero. Filenames are compared without
    case and then as they are."""
    if column == "filename":
        keys = [F.lower("filename"), F.col("filename")]
    elif column in ("page_count", "download_count"):
        keys = [F.coalesce(column, F.lit(0))]
    elif column == "uploaded_at":
        keys = [F.col(column)]
    else:
        raise ValueError(f"no order by {column}")
    return [k.desc() if descending else k.asc() for k in keys] + [F.col("id")]


#: Plain lists: comments in the order they were made, bookmarks and documents newest first, people by name.
LISTS = {
    "comments": ["created_at", "id"],
    "bookmarks": ["-created_at", "doc_id"],
    "documents": ["-uploaded_at", "-id"],
    "admins": ["email"],
    "users": ["email"],
    "permissions": ["user_email"],
}


def listed(df: DataFrame, kind: str) -> DataFrame:
    """df in the order of LISTS."""
    return df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in LISTS[kind]])


def latency(df: DataFrame, seconds: str = "seconds") -> DataFrame:
    """mean and max of seconds, rounded to milliseconds."""
    return df.agg(F.round(F.avg(seconds), 3).alias("mean"), F.round(F.max(seconds), 3).alias("max"))


def pages_of(items: DataFrame) -> DataFrame:
    """doc_id, page, text: items (doc_id, page, kind, place, text) by page, texts before tables and each in
    order of their places, lines apart. Items without a page are on the first."""
    page = F.coalesce("page", F.lit(1)).alias("page")
    parts = F.array_sort(F.collect_list(F.struct((F.col("kind") == "table").alias("table"), "place", "text")))
    return items.groupBy("doc_id", page).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def top_down(tables: Column) -> Column:
    """An array of boxes (y0, x0, ...) from the top of a page to its end."""
    return F.array_sort(tables)


def backfill(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The index's rows of all chunks with their documents' names, empty where there is none."""
    meta = docs.select(F.col("id").alias("_id"), "filename", "title", "memo")
    joined = chunks.join(meta, F.col("doc_id") == F.col("_id"), "left")
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("filename", "title", "memo")]
    return joined.select("chunk_id", "doc_id", *named, *[c for c in ("text", "page_num", "chunk_idx", "embedding") if c in chunks.columns])


def owned_filter(df: DataFrame, owner: str, user: str, admin: bool) -> DataFrame:
    """Rows that a user may change."""
    return df.where(may_change(F.col(owner), F.lit(user), F.lit(admin)))


