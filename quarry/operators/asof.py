"""As-of joins as plans: each row meets the last row of the other side at or before its own place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, by: list[str], at: str, bring: list[str], asks: str) -> DataFrame:
    """The rows with `asks`, with the values of `bring` of the last row of their key without it at or
    before their place; both kinds stand in one table. Of those at one place the greatest values count.
    One window over by and at, so the rows of a key are sorted and never held."""
    last = F.last(F.when(~F.col(asks), F.struct(*bring)), ignorenulls=True)
    w = Window.partitionBy(*by).orderBy(at, asks, *bring).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_met", last.over(w)).where(F.col(asks))
    return met.withColumns({c: F.col("_met")[c] for c in bring}).drop("_met", asks)


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, bring: list[str], width: float | None = None, within: float | None = None) -> DataFrame:
    """left with the columns `bring` of right's last row with the same `by` and a place `at` not after its
    own; null where there is none, or none within that distance. Null keys and places meet nothing; every
    row of left stays, and columns of left with names of `bring` are replaced.

    width splits each key by stretches of that many units of `at`, which must be a number then: a key with
    a large share of all rows is worked on by many tasks. What a stretch starts with is the last of the
    stretches before it, found among one row for each stretch.
    """
    left = left.drop(*bring)
    cell = [] if width is None else ["_cell"]
    own = [c for c in left.columns if c not in (*by, at)]
    known = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, at)))
    asked = left.select(*by, at, F.struct(*own).alias("_row") if own else F.lit(None).cast("struct<_:int>").alias("_row"), *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in bring], F.lit(None).cast(known.schema[at].dataType).alias("_from"), F.lit(True).alias("_asks"))
    given = known.select(*by, at, F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), *bring, F.col(at).alias("_from"), F.lit(False).alias("_asks"))
    rows = asked.unionByName(given)
    values = ["_from", *bring]
    if width is not None:
        rows = rows.withColumn("_cell", F.floor(F.col(at) / width))
        held = F.struct(at, *bring)
        cells = rows.groupBy(*by, "_cell").agg(F.max(F.when(~F.col("_asks"), held)).alias("_last"))
        before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        carry = cells.withColumn("_last", F.last("_last", ignorenulls=True).over(before)).where("_last IS NOT NULL")
        start = carry.select(*by, (F.col("_cell") * width).cast(rows.schema[at].dataType).alias(at), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *[F.col("_last")[c].alias(c) for c in bring], F.col("_last")[at].alias("_from"), F.lit(False).alias("_asks"), "_cell")
        rows = rows.unionByName(start)
    met = carried(rows, [*by, *cell], at, values, "_asks")
    if within is not None:
        near = F.col(at) - F.col("_from") <= within
        met = met.withColumns({c: F.when(near, F.col(c)) for c in bring})
    return met.select(*by, at, *[F.col("_row")[c].alias(c) for c in own], *bring).select(*left.columns, *bring)
