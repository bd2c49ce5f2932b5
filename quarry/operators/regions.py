"""Blocks and tables of pages: which points lie in which boxes, and the text of a page of both.

A box is put into the cells of a grid that it touches, a point into its one cell, and they meet by an
equality join on page and cell with the exact test after it. Boxes of different sizes use grids of
different width, each twice as wide as the one before, so that a box touches at most 81 cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators.admin import top_down

CELL = 32.0


def _level(cell: float):
    """The grid whose cells are at least an eighth of a box's longer side."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1e-9)) / (8 * cell)))).cast("int")


def boxes_of(points: DataFrame, boxes: DataFrame, by: list[str], key: list[str], box: str, cell: float = CELL) -> DataFrame:
    """by, key, box: every box (by, box, x0, y0, x1, y1, edges included) that a point (by, key, x, y) lies
    in. Points and boxes without places, and boxes whose edges are the wrong way round, meet nothing."""
    real = boxes.where("x0 <= x1 AND y0 <= y1").select(*by, box, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    sized = real.withColumn("_l", _level(cell)).withColumn("_w", F.pow(F.lit(2.0), F.col("_l")) * cell)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.col("_w")), F.floor(F.col(b) / F.col("_w"))))
    touched = sized.withColumn("_i", span("x0", "x1")).withColumn("_j", span("y0", "y1"))
    # A page's points look into the grids that its boxes use, a few for each page.
    grids = sized.groupBy(*by).agg(F.collect_set("_l").alias("_ls"))
    seen = points.select(*by, *key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(grids, by).withColumn("_l", F.explode("_ls"))
    width = F.pow(F.lit(2.0), F.col("_l")) * cell
    placed = seen.withColumns({"_i": F.floor(F.col("x") / width), "_j": F.floor(F.col("y") / width)})
    met = placed.join(touched, [*by, "_l", "_i", "_j"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return met.select(*by, *key, box).distinct()


def outside(blocks: DataFrame, tables: DataFrame, by: list[str], key: list[str], table: str, cell: float = CELL) -> DataFrame:
    """The blocks that lie in no table: the text of a table is not said twice."""
    inside = boxes_of(blocks, tables, by, key, table, cell).select(*by, *key).distinct()
    return blocks.join(inside, [*by, *key], "left_anti")


def page_texts(blocks: DataFrame, tables: DataFrame, by: list[str], key: list[str], table: str, cell: float = CELL) -> DataFrame:
    """by, text: the blocks of each page outside of tables (by, key, x, y, text) line by line in the order of
    their keys, and after an empty line its tables (by, table, box, markdown) from the top down."""
    lines = outside(blocks, tables, by, key, table, cell).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*key, "text"))).alias("ls"))
    grids = tables.groupBy(*by).agg(top_down(F.collect_list(F.struct("y0", "x0", table, "markdown"))).alias("ts"))
    text = F.array_join(F.transform(F.coalesce("ls", F.array().cast(lines.schema["ls"].dataType)), lambda b: b["text"]), "\n")
    grid = F.array_join(F.transform("ts", lambda t: t["markdown"]), "\n\n")
    both = lines.join(grids, by, "full_outer")
    return both.select(*by, F.when(F.col("ts").isNull(), text).otherwise(strip(F.concat(text, F.lit("\n\n"), grid))).alias("text"))


def routed(text_pages: DataFrame, scan_pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The pages (doc, page, text, method, ...) of both readers, each number once: where both have a page
    the scan's stays. In order within a document, which gets its place as `ordinal`."""
    pages = text_pages.withColumn("_p", F.lit(0)).unionByName(scan_pages.withColumn("_p", F.lit(1)))
    kept = pages.groupBy(doc, "page").agg(F.max_by(F.struct(*[c for c in text_pages.columns if c not in (doc, "page")]), "_p").alias("_r"))
    order = F.row_number().over(Window.partitionBy(doc).orderBy("page"))
    return kept.select(doc, "page", "_r.*", order.alias("ordinal"))
