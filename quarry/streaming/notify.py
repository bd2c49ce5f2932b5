"""Notifications and the search log as streams: a source that sends a row again adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.operators.documents import fan_out
from quarry.operators.lifecycle import log_rows


def once(rows: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Each key once: ids are remembered until the watermark has passed their time, and what is later
    than that is dropped."""
    return rows.withColumn("_at", rows[at].cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(key)


def fan_out_stream(comments: DataFrame, docs: DataFrame, users: DataFrame, late: str = "1 day") -> DataFrame:
    """fan_out for a stream of comments: joined with the documents and users that there are when a batch runs."""
    return fan_out(once(comments, ["id"], "created_at", late), docs, users)


def search_log_stream(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """log_rows for a stream of calls (id, query, user_email, result_count, searched_at)."""
    return log_rows(once(calls, ["id"], "searched_at", late))
