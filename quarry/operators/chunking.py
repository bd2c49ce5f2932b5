"""Chunks, snippets and page rules.

A chunk is a span of a document's text: sections between headings where there are two headings or
more, cut into windows that end at natural boundaries. The cutting depends on where the last cut
fell, so it runs as Python over Arrow batches; everything else is column expressions and an as-of join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import grade, strip
from quarry.operators.asof import carried

LONGEST, OVERLAP, SHORTEST, LOOK_BACK = 400, 80, 20, 100
#: Headings, and boundaries in the order in which they are preferred.
HEADING = re.compile(r"^(?:#{1,4}\s+.+|\d+(?:\.\d+)*\.\s+\S.{0,60}|제\s*\d+\s*[장절항].{0,40})", re.M)
BOUNDARIES = ("\n\n", "\n", ". ", "? ", "! ", "。", "？", "！")

CHUNK_SCHEMA = "chunk_idx int, char_start long, char_end long, text string"


def _boundary(text: str, start: int, end: int) -> int:
    """Where a window that may reach end is cut: after the last place of the first boundary found."""
    low = max(start + 1, end - LOOK_BACK)
    places = ((text.rfind(b, low, end), len(b)) for b in BOUNDARIES)
    return next((at + size for at, size in places if at >= 0), end)


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Spans of a text that is longer than one chunk; a short last piece goes unless it is alone."""
    start, found = 0, False
    while start + LONGEST < len(text):
        end = _boundary(text, start, start + LONGEST)
        if text[start:end].strip():
            found = True
            yield start, end
        start = end - OVERLAP if end - OVERLAP > start else end
    tail = len(text[start:].strip())
    if tail >= OVERLAP or (tail and not found):
        yield start, len(text)


def spans(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(char_start, char_end, chunk) of a text.

    With two headings or more what stands before the first is left out. Places count from the
    section's start without the white space stripped there.
    """
    if not text or not text.strip():
        return
    heads = [m.start() for m in HEADING.finditer(text)]
    edges = [*heads, len(text)] if len(heads) > 1 else [0, len(text)]
    for begin, end in zip(edges, edges[1:]):
        section = text[begin:end].strip()
        if not section:
            continue
        if len(section) <= LONGEST:
            yield begin, begin + len(section), section
        else:
            for a, b in _windows(section):
                yield begin + a, begin + b, section[a:b].strip()


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id and CHUNK_SCHEMA."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows = [(d, i, *s) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, s in enumerate(spans(t))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "chunk_idx", "char_start", "char_end", "text"])


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, char_start, char_end, text of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(chunk_rows, "doc_id long, " + CHUNK_SCHEMA)


def joined_pages(docs: DataFrame) -> DataFrame:
    """doc_id, text, offsets: the pages worth indexing (not flagged, not blank) of docs (doc_id,
    pages array<struct<page, text, flagged>>), stripped and joined by newlines, and where each starts."""
    kept = F.filter(F.transform("pages", lambda p: F.struct(p["page"].alias("page"), strip(F.coalesce(p["text"], F.lit(""))).alias("text"), F.coalesce(p["flagged"], F.lit(False)).alias("flagged"))), lambda p: ~p["flagged"] & (p["text"] != ""))
    size = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)["next"]).otherwise(F.lit(0).cast("long"))
    none = F.array().cast("array<struct<off: bigint, page: bigint, next: bigint>>")
    step = lambda acc, p: F.concat(acc, F.array(F.struct(size(acc).alias("off"), p["page"].cast("long").alias("page"), (size(acc) + F.length(p["text"]) + 1).cast("long").alias("next"))))
    out = docs.withColumn("_kept", kept).where(F.size("_kept") > 0)
    return out.select("doc_id", F.array_join(F.transform("_kept", lambda p: p["text"]), "\n").alias("text"), F.aggregate("_kept", none, step).alias("offsets"))


def page_at(offsets: Column, place: Column) -> Column:
    """The last page that starts at or before a place, of few pages in an array; the first where none does."""
    before = F.filter(offsets, lambda o: o["off"] <= place)
    return F.coalesce(F.get(before, F.size(before) - 1)["page"], F.get(offsets, F.lit(0))["page"])


def page_chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, offsets -> the chunks of each document and the starts of its pages, a row each:
    doc_id, at, chunk_idx, page_num, text, asks (whether the row is a chunk, whose page is asked)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows: list[tuple] = []
            for doc, text, offsets in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "offsets"))):
                rows += [(doc, o["off"], None, o["page"], None, False) for o in offsets]
                rows += [(doc, begin, i, None, chunk, True) for i, (begin, _, chunk) in enumerate(spans(text)) if len(chunk) >= SHORTEST]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "at", "chunk_idx", "page_num", "text", "asks"])


def page_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, page_num, text of the chunks long enough to be indexed, with the page that each
    starts on: the last page start at or before the chunk's, one scan and one shuffle by doc_id."""
    rows = joined_pages(docs).mapInArrow(page_chunk_rows, "doc_id long, at long, chunk_idx int, page_num long, text string, asks boolean")
    return carried(rows, ["doc_id"], "at", ["page_num"], "asks").select("doc_id", "chunk_idx", "page_num", "text")


def snippet(text: str, tokens: list[str], size: int = 200) -> str:
    """The window around the token that has most tokens near it, the first of equals."""
    if not tokens or not text.strip():
        head = text.strip()
        return head[:size] + "…" * (len(head) > size)
    low = text.lower()
    places = sorted({(order, m.start()) for order, t in enumerate(tokens) for m in re.finditer(f"(?={re.escape(t)})", low)})
    lead = 60

    def near(at: int) -> int:
        part = low[max(0, at - lead) : min(len(text), at + size - lead)]
        return sum(part.count(t) for t in tokens)

    at = max(places, key=lambda p: near(p[1]), default=(0, 0))[1]
    a, b = max(0, at - lead), min(len(text), at + size - lead)
    return "…" * (a > 0) + text[a:b].strip() + "…" * (b < len(text))


def snippets(df: DataFrame, tokens: list[str], text: str = "text", out: str = "snippet") -> DataFrame:
    """Adds the snippet of each row for lower-cased tokens; meant for a page of results."""

    def make(s: pd.Series) -> pd.Series:
        return s.map(lambda t: snippet(t or "", tokens))

    return df.withColumn(out, F.pandas_udf(make, "string")(F.col(text)))


def snippet_tokens(query: str) -> list[str]:
    return [t.lower() for t in re.split(r"[\s\W]+", query.strip()) if len(t) >= 2]


def page_flags(scores: DataFrame) -> DataFrame:
    """page_id, parse_grade, ocr_grade, flagged, reread: a page read by recognition alone is flagged
    when that was poor or fair; one whose text layer is poor is to be read again."""
    parse, ocr = grade(F.col("parse_score")), grade(F.col("ocr_score"))
    flagged = (parse == "UNSPECIFIED") & ocr.isin("POOR", "FAIR")
    return scores.select("page_id", parse.alias("parse_grade"), ocr.alias("ocr_grade"), flagged.alias("flagged"), (parse == "POOR").alias("reread"))


def reread(pages: DataFrame) -> DataFrame:
    """pages (parse_score, text, fallback, method) with the fallback's text where the text layer is poor
    and the fallback has any."""
    poor = (grade(F.col("parse_score")) == "POOR") & (F.coalesce("fallback", F.lit("")) != "")
    return pages.withColumns({"text": F.when(poor, F.col("fallback")).otherwise(F.col("text")), "method": F.when(poor, "fallback").otherwise(F.col("method"))}).drop("fallback")


def ingest_report(parsed: DataFrame) -> DataFrame:
    """doc_id, status, total_pages, indexed_pages, flagged_pages of parsed (doc_id, status, pages): failed
    stays failed; flagged and blank pages are left out, and where nothing is left a document is skipped.
    Nothing of a failed document counts."""
    failed = F.col("status") == "failed"
    flagged = F.transform(F.filter("pages", lambda p: F.coalesce(p["flagged"], F.lit(False))), lambda p: p["page"])
    good = F.filter("pages", lambda p: ~F.coalesce(p["flagged"], F.lit(False)) & (strip(F.coalesce(p["text"], F.lit(""))) != ""))
    zero = lambda n: F.when(failed, 0).otherwise(n)
    return parsed.select(
        "doc_id",
        F.when(failed, "failed").when(F.size(good) == 0, "skipped").otherwise("success").alias("status"),
        zero(F.size("pages")).alias("total_pages"),
        F.when(failed, 0).otherwise(F.size(good)).alias("indexed_pages"),
        F.when(failed, F.array().cast("array<int>")).otherwise(flagged.cast("array<int>")).alias("flagged_pages"),
    )


def weighted_confidence(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """Confidence of each page weighted by the length of its blocks (text, conf); 0 without text."""
    size = F.length("text")
    return blocks.groupBy(page).agg(F.round(F.coalesce(F.sum(size * F.col("conf")) / F.nullif(F.sum(size), F.lit(0)), F.lit(0.0)), 4).alias("confidence"))


def page_kind(text: Column) -> Column:
    """text with ten characters or more after stripping, else scan."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) >= 10, "text").otherwise("scan")


def inside_any(tables: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in any of the boxes (x0, y0, x1, y1)."""
    return F.exists(tables, lambda t: x.between(t["x0"], t["x1"]) & y.between(t["y0"], t["y1"]))


def grid_markdown(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """Markdown of sparse cells (table_id, row, col, place, text): what shares a cell is joined in
    order, gaps stay empty, and a table without text is empty."""
    from quarry.functions.text import cell

    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " "))
    merged = cells.groupBy(key, "row", "col").agg(cell(text).alias("text"))
    shape = merged.groupBy(key).agg(F.max("row").alias("rows"), F.max("col").alias("cols"), F.max(F.col("text") != "").alias("any"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "row", "col"), "text"))).alias("m"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("cols")), lambda c: F.coalesce(F.try_element_at(F.col("m"), F.concat_ws(":", r, c)), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), (F.col("cols") + 1).cast("int")), " | "), F.lit(" |"))
    rest = F.when(F.col("rows") > 0, F.transform(F.sequence(F.lit(1), F.greatest("rows", F.lit(1))), line)).otherwise(F.array().cast("array<string>"))
    return shape.select(key, F.when(F.col("any"), F.array_join(F.concat(F.array(line(F.lit(0)), rule), rest), "\n")).otherwise("").alias("markdown"))
