"""One search call: which plan a mode and a query mean, and what comes after the cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import contains_ignoring_case, or_else, strip
from quarry.operators import documents as D
from quarry.operators import search as S
from quarry.operators.chunking import snippet_tokens, snippets
from quarry.sources.vector_lists import VectorLists, VectorTable

BROWSED, NAMED = 200, 50
#: What a result shows, in this order.
SHOWN = (
    "position", "doc_id", "filename", "category", "pages", "snippet", "content_preview", "page_num", "score", "download_count", "uploaded_by", "uploaded_at",
    "file_type", "title", "memo", "uploaded_by_name",
)


def _newest(docs: DataFrame, limit: int) -> DataFrame:
    """The newest documents with their places; at most `limit` rows are numbered."""
    newest = Window.partitionBy().orderBy(F.desc("uploaded_at"), F.desc("id"))
    shown = docs.withColumns({"snippet": or_else(F.col("title"), F.col("filename")), "content_preview": strip(F.substring("text", 1, 150))}).drop("text")
    return D.newest(shown, limit).withColumns({"place": F.row_number().over(newest), "page_num": F.lit(0).cast("long"), "score": F.lit(0.0)})


def _semantic(
    seen: DataFrame, query: str, index: DataFrame, stats: DataFrame | None, chunks: DataFrame | None, vectors: DataFrame | VectorLists | VectorTable | None, query_vector: list[float] | None
) -> DataFrame:
    """The best documents with their places; text and page are those of the best chunk of each.

    The ranking runs here: its page has at most RESULTS rows, and their ids are put into the filters of
    the scans of chunks and documents, which read the row groups that hold them.
    """
    allowed = seen.select(F.col("id").alias("doc_id"))
    hits = S.bm25(index, S.field_stats(index) if stats is None else stats, S.query_terms(query), allowed=allowed)
    hits = S.top(S.best_per_doc(hits), S.BM25_DOCS)
    if vectors is None or query_vector is None:
        near = hits.limit(0)
    elif isinstance(vectors, DataFrame):
        near = S.knn(vectors, query_vector, allowed=allowed)
    else:
        near = vectors.nearest(query_vector, allowed=allowed)
    page = S.final_page(S.hybrid(hits, near)).select("doc_id", "score", "place", "chunk_id")
    rows = page.collect()
    page = seen.sparkSession.createDataFrame(rows, page.schema)
    if chunks is None:
        chunks = seen.select(F.col("id").alias("chunk_id"), "text", F.lit(0).alias("page_num"))
    best = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in rows])).select("chunk_id", "text", F.col("page_num").cast("long").alias("page_num")).join(F.broadcast(page), "chunk_id")
    found = seen.where(F.col("id").isin([r["doc_id"] for r in rows])).drop("text").join(F.broadcast(best), F.col("id") == F.col("doc_id")).drop("doc_id", "chunk_id")
    return snippets(found, snippet_tokens(query)).withColumn("content_preview", F.col("snippet")).drop("text")


def search(
    docs: DataFrame,
    permissions: DataFrame,
    users: DataFrame,
    query: str = "",
    mode: str = "filename",
    index: DataFrame | None = None,
    stats: DataFrame | None = None,
    chunks: DataFrame | None = None,
    vectors: DataFrame | VectorLists | VectorTable | None = None,
    query_vector: list[float] | None = None,
    user: str | None = None,
    department: str | None = None,
    admin: bool = False,
    file_type: str | None = None,
    **filters: str | None,
) -> DataFrame:
    """A page of results in order, position 1 first.

    A blank query lists the newest documents in any mode; an unknown mode means filename. Access
    and file type narrow what is left after the cut, never what the cut chooses from. Without a
    query vector there are keyword hits only. chunks (chunk_id, text, page_num) are what index and
    vectors point to; without them each document is its own chunk. Without an index a semantic
    search raises IndexUnavailable, which is not the same as no results.
    """
    seen = D.visible(docs, **filters)
    if not query.strip():
        found = _newest(seen, BROWSED)
    elif mode != "semantic":
        found = _newest(seen.where(contains_ignoring_case(F.col("filename"), query.strip())), NAMED)
    elif index is None:
        raise S.IndexUnavailable("a semantic search needs an index")
    else:
        found = _semantic(seen, query, index, stats, chunks, vectors, query_vector)
    out = D.display_name(D.readable(found, permissions, user, department, admin), users, "uploaded_by", "uploaded_by_name")
    if file_type:
        out = out.where(F.col("file_type") == file_type)
    # A page at most: renumbered where access or type have left gaps.
    out = out.withColumn("position", F.row_number().over(Window.partitionBy().orderBy("place")))
    return out.withColumnsRenamed({"id": "doc_id", "page_count": "pages"}).select(*SHOWN).orderBy("position")


def log_row(query: str, user: str | None, results: int, as_of: str) -> dict | None:
    """The search log's row for a call; none for a blank query."""
    return {"query": query, "user_email": user or "anonymous", "result_count": results, "searched_at": as_of} if query.strip() else None
