"""Points in boxes by grids against a plain search, and the texts of pages with tables."""

import random

from pyspark.sql import functions as F

from quarry.operators import regions as R


def made(spark, rng, n=300):
    points = [(rng.randint(0, 3), i, rng.choice([None, float("nan")]) if rng.random() < 0.02 else rng.uniform(-200, 2000), rng.uniform(-200, 900), f"t{i}") for i in range(n)] + [(9, 1, 1.0, 1.0, "no boxes")]
    boxes = []
    for i in range(60):
        x, y, w, h = rng.uniform(-100, 1800), rng.uniform(-100, 800), rng.choice([0, 3, 40, 300, 5000]), rng.choice([0, 5, 60, 700])
        boxes.append((rng.randint(0, 4), i, x, y, x + w, y + h, f"m{i}"))
    boxes += [(0, 60, 5.0, 5.0, 1.0, 9.0, "wrong way"), (1, 61, None, 0.0, 9.0, 9.0, "no place"), (2, 62, points[0][2] or 0.0, points[0][3], points[0][2] or 0.0, points[0][3], "a point")]
    return (
        points,
        boxes,
        spark.createDataFrame(points, "page long, place long, x double, y double, text string").repartition(3),
        spark.createDataFrame(boxes, "page long, table_id long, x0 double, y0 double, x1 double, y1 double, markdown string"),
    )


def plain(points, boxes):
    return {(p, k, t) for p, k, x, y, _ in points if x is not None for q, t, x0, y0, x1, y1, _ in boxes if p == q and x0 is not None and x0 <= x <= x1 and y0 <= y <= y1}


def test_against_a_plain_search(spark):
    for seed, cell in ((1, 32.0), (2, 4.0), (3, 5000.0)):
        points, boxes, a, b = made(spark, random.Random(seed))
        got = R.boxes_of(a, b, ["page"], ["place"], "table_id", cell)
        assert {tuple(r) for r in got.collect()} == plain(points, boxes) and got.count() == len(plain(points, boxes)) > 10


def test_no_nested_loop_and_bounded_cells(spark):
    *_, a, b = made(spark, random.Random(1))
    found = R.boxes_of(a, b, ["page"], ["place"], "table_id")
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    real = b.where("x0 <= x1 AND y0 <= y1").withColumn("l", R._level(R.CELL)).withColumn("w", F.pow(F.lit(2.0), F.col("l")) * R.CELL)
    cells = real.select(((F.floor(F.col("x1") / F.col("w")) - F.floor(F.col("x0") / F.col("w")) + 1) * (F.floor(F.col("y1") / F.col("w")) - F.floor(F.col("y0") / F.col("w")) + 1)).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 81


def test_texts_of_pages(spark):
    points, boxes, a, b = made(spark, random.Random(5))
    inside = {(p, k) for p, k, _ in plain(points, boxes)}
    got = {r.page: r.text for r in R.page_texts(a, b.where("x0 IS NOT NULL"), ["page"], ["place"], "table_id").collect()}
    for page in range(5):
        lines = "\n".join(t for p, k, *_, t in points if p == page and (p, k) not in inside)
        grids = "\n\n".join(m for *_, m in sorted((y0, x0, i, m) for p, i, x0, y0, _, _, m in boxes if p == page and x0 is not None))
        assert got[page] == f"{lines}\n\n{grids}".strip()
    assert got[9] == "no boxes"


def test_routed_pages(spark):
    page = "doc_id long, page long, text string, method string"
    text = spark.createDataFrame([(1, 1, "a", "text"), (1, 3, "b", "text"), (2, 1, "c", "text")], page)
    scan = spark.createDataFrame([(1, 2, "s", "ocr"), (1, 3, "over", "ocr"), (3, 7, "alone", "ocr")], page)
    got = R.routed(text, scan).orderBy("doc_id", "page").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a", "text", 1), (1, 2, "s", "ocr", 2), (1, 3, "over", "ocr", 3), (2, 1, "c", "text", 1), (3, 7, "alone", "ocr", 1)]
    assert R.routed(text.limit(0), scan.limit(0)).collect() == []
