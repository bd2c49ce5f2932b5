"""Continuous behaviour as Structured Streaming: ingest, counts and the rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.parse import parsed

WINDOW_SECONDS, MAX_REQUESTS = 60, 180


def daily_counts(events: DataFrame, at: str = "ts", by: str = "event_type", late: str = "1 day") -> DataFrame:
    """Events of each type in tumbling days of event time; state of days past the watermark goes."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    n = timed.groupBy(F.window(at, "1 day"), by).agg(F.count("*").alias("n"))
    return n.select(F.to_date(F.col("window.start")).alias("day"), by, "n")


def allowed_times(times: list[float], log: list[float], window: float = WINDOW_SECONDS, most: int = MAX_REQUESTS) -> tuple[list[bool], list[float]]:
    """Which requests of one key pass, in order, and the log after them. Refused ones leave no trace."""
    out, kept = [], list(log)
    for now in times:
        kept = [t for t in kept if t >= now - window]
        ok = len(kept) < most
        if ok:
            kept.append(now)
        out.append(ok)
    return out, kept


def limited(requests: DataFrame, window: float = WINDOW_SECONDS, most: int = MAX_REQUESTS, expire: bool = True) -> DataFrame:
    """key, at, allowed for a stream of requests (key string, at timestamp): a sliding log for each key.

    The state of a key holds at most `most` times. With expire, for streams without an end, it goes
    when the key has been idle for a window; a finite stream would wait for that forever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        ok, log = allowed_times([t.timestamp() for t in rows["at"]], log, window, most)
        state.update((log,))
        if expire:
            state.setTimeoutDuration(int(window * 1000))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "allowed": ok})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return requests.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, allowed boolean", "log array<double>", "append", timeout)


def limited_batch(requests: DataFrame, window: int = WINDOW_SECONDS, most: int = MAX_REQUESTS) -> DataFrame:
    """Requests (key, at) with those of the window before each and whether it is over the limit.

    Refused requests count here too, which the sliding log leaves out; the two agree while nothing
    is refused.
    """
    from pyspark.sql import Window

    seconds = F.unix_seconds(F.col("at").cast("timestamp"))
    w = Window.partitionBy("key").orderBy(seconds).rangeBetween(-window, 0)
    return requests.withColumn("in_window", F.count("*").over(w)).withColumn("over", F.col("in_window") > most)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_each: int = 100, parsers: dict | None = None):
    """Parse new files of a folder and append their results; each file is taken once.

    Returns the running query. A batch that is written again after a failure replaces itself: its
    number names its folder.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_each).load(folder)
    return ingest_stream(source, out, checkpoint, parsers)


def ingest_stream(files: DataFrame, out: str, checkpoint: str, parsers: dict | None = None):
    """ingest for any stream of files (path, content)."""

    def write(batch: DataFrame, number: int) -> None:
        parsed(batch, parsers).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(stream: DataFrame, out: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a finite stream to its end and give its result, written as Parquet under out.

    Executors write a folder for each batch, again where a batch is run again; of a complete result the
    last batch counts, of an appended one all do. A stream without any batch gives no rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(out)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = sorted(int(s.getPath().getName().split("=")[1]) for s in system.listStatus(folder)) if system.exists(folder) else []
    if not batches:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{out}/batch={n}" for n in (batches[-1:] if mode == "complete" else batches)]
    return spark.read.schema(stream.schema).parquet(*paths)


def settled(docs: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """One row: whether every parsed document has chunks or is flagged, and the index has them all."""
    have = chunks.select(F.col("doc_id").alias("_d")).distinct()
    open_ = docs.where((F.col("status") == "success") & ~F.col("has_flagged")).join(have, docs.id == have._d, "left_anti").agg(F.count("*").alias("waiting"))
    sizes = chunks.agg(F.count("*").alias("chunks")).join(index.agg(F.count("*").alias("indexed")))
    return open_.join(sizes).withColumn("settled", (F.col("waiting") == 0) & (F.col("chunks") == F.col("indexed")))
