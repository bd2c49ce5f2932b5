"""Ingestion as a log of status events, from which the state of every document is read.

A batch first notes that its files are being parsed, then writes their results, then notes how each one
ended. All three are folders named by the batch's number and written over when a batch is run again, so
a replay after a failure changes nothing and a file whose batch was lost stays `parsing` only until the
replay, or until the sweep of stale ones ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quarry.functions.text import title_of
from quarry.sources.parse import RESULT, Parser, parsed

EVENT = "source_file string, status string, error string, title string, page_count int, has_flagged boolean, at timestamp"
_PARTS = EVENT + ", batch long, step int"


def outcome(results: DataFrame) -> DataFrame:
    """What a document's row takes from parse results: status, error, title, page_count, has_flagged. A
    failed one has no pages and nothing flagged."""
    good = F.col("status") == "success"
    return results.select(
        "source_file",
        "status",
        "error",
        F.when(good, title_of(F.transform("pages", lambda p: p["text"]))).alias("title"),
        F.when(good, F.size("pages")).otherwise(0).alias("page_count"),
        (good & F.exists("pages", lambda p: F.coalesce(p["flagged"], F.lit(False)))).alias("has_flagged"),
    )


def write_batch(files: DataFrame, number: int, out: str, parsers: dict[str, Parser] | None = None) -> None:
    """The three writes of a batch of files (path, content) under out."""
    spark = files.sparkSession
    name = F.element_at(F.split("path", "/"), -1).alias("source_file")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("error", "string"), ("title", "string"), ("page_count", "int"), ("has_flagged", "boolean"))]
    begun = files.select(name, F.lit("parsing").alias("status"), *none, F.current_timestamp().alias("at"))
    begun.write.mode("overwrite").parquet(f"{out}/events/batch={number}/step=1")
    parsed(files, parsers).write.mode("overwrite").parquet(f"{out}/results/batch={number}")
    done = outcome(spark.read.schema(RESULT).parquet(f"{out}/results/batch={number}")).withColumn("at", F.current_timestamp())
    done.write.mode("overwrite").parquet(f"{out}/events/batch={number}/step=2")


def ingest_with_status(files: DataFrame, out: str, checkpoint: str, parsers: dict[str, Parser] | None = None) -> StreamingQuery:
    """Run a stream of files (path, content) to its end. Each batch's progress carries the metrics `files`
    (n, bytes), for a listener such as Progress."""
    seen = files.observe("files", F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes"))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write_batch(batch, number, out, parsers)
        finally:
            batch.unpersist()

    return seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_PARTS).parquet(f"{out}/events")


def document_states(log: DataFrame) -> DataFrame:
    """The last event of each file: what its document's row is to show."""
    shown = ("status", "error", "title", "page_count", "has_flagged", "at")
    last = F.max_by(F.struct(*shown), F.struct("batch", "step"))
    return log.groupBy("source_file").agg(last.alias("_last"), F.count("*").alias("n_events")).select("source_file", *[F.col("_last")[c].alias(c) for c in shown], "n_events")


def polled(log: DataFrame, names: list[str]) -> DataFrame:
    """The states of a few files, as a client asks for them until none is parsing."""
    return document_states(log.where(F.col("source_file").isin(names))).select("source_file", "status", "error", "page_count", "has_flagged")


def swept(states: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """States with those that have been parsing for longer than that as failed."""
    stale = (F.col("status") == "parsing") & (F.col("at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return states.withColumns({"error": F.when(stale, "parsing was interrupted").otherwise(F.col("error")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


class Progress(StreamingQueryListener):
    """Keeps the number of files and bytes of each batch of the queries that run while it listens."""

    def __init__(self) -> None:
        self.batches: dict[int, tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("files")
        if row is not None and row["n"]:
            self.batches[event.progress.batchId] = (row["n"], row["bytes"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
