"""The limiter on keyed state, the log of status events, and streams that are sent rows twice."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.operators import documents as D
from quarry.streaming import jobs as J
from quarry.streaming import status as U
from quarry.streaming.limiter import keyed_state, limited_in_order
from quarry.streaming.notify import fan_out_stream, search_log_stream

START = 1_000_000_000
END = 4_000_000_000  # microseconds: a request far behind all others, that lets them be decided


def plain_log(requests, window, most):
    out, logs = [], defaultdict(list)
    for key, at in sorted(requests):
        logs[key] = [t for t in logs[key] if t >= at - window]
        ok = len(logs[key]) < most
        if ok:
            logs[key].append(at)
        out.append((key, at, ok))
    return sorted(out)


def write(spark, path, requests):
    df = spark.createDataFrame(requests, "key string, us long").select("key", F.timestamp_micros("us").alias("at"))
    df.coalesce(1).write.mode("append").parquet(path)


def decide(spark, base, window, most, late="10 seconds", files=1):
    stream = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    with keyed_state(spark):
        out = J.run_to_files(limited_in_order(stream, window, most, late), f"{base}/out", "append", f"{base}/state")
    return sorted((r.key, r.us, r.allowed) for r in out.select("key", F.unix_micros("at").alias("us"), "allowed").collect() if r.us < END)


def test_181_requests_then_one_after_the_window(spark, tmp_path):
    times = [START + i * 330_000 for i in range(181)] + [START + 61_000_000]
    write(spark, f"{tmp_path}/in", [("k", t) for t in times])
    write(spark, f"{tmp_path}/in", [("end", END)])
    got = decide(spark, tmp_path, 60, 180)
    assert got == plain_log([("k", t) for t in times], 60_000_000, 180)
    assert [ok for *_, ok in got].count(False) == 1 and got[-1] == ("k", START + 61_000_000, True)


def test_out_of_order_and_after_a_restart(spark, tmp_path):
    """Requests of one window arrive in many batches and in no order; a second run goes on from the state
    that the first left."""
    rng = random.Random(6)
    parts = [[(rng.choice("abbbbc"), START + rng.randrange(low * 1_000_000, high * 1_000_000, 250_000)) for _ in range(90)] for low, high in ((0, 40), (10, 60), (30, 80), (50, 100))]
    for part in parts[:2]:
        write(spark, f"{tmp_path}/in", part)
    done = decide(spark, tmp_path, 5, 7, late="30 seconds")
    for part in (*parts[2:], [("end", END)]):
        write(spark, f"{tmp_path}/in", part)
    got = decide(spark, tmp_path, 5, 7, late="30 seconds")
    want = plain_log([r for part in parts for r in part], 5_000_000, 7)
    assert 0 < len(done) < 180 and set(done) <= set(want)
    assert got == want and {ok for *_, ok in got} == {True, False}


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_replayed_batch_changes_nothing_and_failures_converge(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = files(spark, [("/in/a.txt", b"A title line\nand text"), ("/in/b.bin", b"x"), ("/in/c.hwpx", b"no zip"), ("/in/d.txt", b"")])
    U.write_batch(batch, 0, log)
    one = U.document_states(U.events(spark, log)).drop("at").collect()
    U.write_batch(batch, 0, log)
    assert sorted(U.document_states(U.events(spark, log)).drop("at").collect()) == sorted(one)
    got = {r.source_file: r for r in one}
    assert (got["a.txt"].status, got["a.txt"].title, got["a.txt"].page_count, got["a.txt"].has_flagged) == ("success", "A title line", 1, False)
    assert got["b.bin"].status == got["c.hwpx"].status == "failed" and got["b.bin"].page_count == 0 and got["c.hwpx"].error
    # A file that is sent again in a later batch takes its last state.
    U.write_batch(files(spark, [("/in/b.bin", b"x"), ("/in/c.txt", b"now it can be read")]), 1, log)
    later = {r.source_file: r.status for r in U.polled(U.events(spark, log), ["b.bin", "c.txt", "gone"]).collect()}
    assert later == {"b.bin": "failed", "c.txt": "success"}


def test_a_lost_batch_is_parsing_until_swept(spark, tmp_path):
    log = str(tmp_path / "log")
    U.write_batch(files(spark, [("/in/a.txt", b"some text")]), 0, log)
    lost = U.events(spark, log).where("step = 1")
    states = U.document_states(lost)
    assert states.first().status == "parsing"
    assert U.swept(states, F.current_timestamp()).first().status == "parsing"
    late = U.swept(states, F.current_timestamp() + F.expr("INTERVAL 11 MINUTES")).first()
    assert (late.status, late.error) == ("failed", "parsing was interrupted")


def test_metrics_of_batches_reach_a_listener(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_text("x" * (i + 1))
    seen = U.Progress()
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 2).load(str(tmp_path / "in"))
        U.ingest_with_status(stream, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
        import time

        for _ in range(100):
            if sum(n for n, _ in seen.batches.values()) == 5:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert sum(n for n, _ in seen.batches.values()) == 5 and sum(b for _, b in seen.batches.values()) == 15
    assert U.document_states(U.events(spark, str(tmp_path / "log"))).where("status = 'success'").count() == 5


def test_rows_sent_twice_notify_once(spark, tmp_path):
    rows = [(i, i % 4, f"u{i % 3}@ex.com", f"said {i}", f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    comments = spark.createDataFrame(rows, "id long, doc_id long, user_email string, content string, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz")).drop("t")
    docs = spark.createDataFrame([(0, "u0@ex.com", "T", "f0"), (1, "u1@ex.com", None, "f1"), (2, "anonymous", "", "f2")], "id long, uploaded_by string, title string, filename string")
    users = spark.createDataFrame([("u0@ex.com", "Zero")], "email string, name string")
    source = str(tmp_path / "in")
    for part in (comments.where("id < 20"), comments.where("id < 30"), comments):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(comments.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = J.run_to_files(fan_out_stream(stream, docs, users), str(tmp_path / "out"), "append", str(tmp_path / "state"))
    want = D.fan_out(comments, docs, users)
    assert want.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    calls = comments.select("id", F.when(F.col("id") % 5 == 0, " ").otherwise("q").alias("query"), F.lit(None).cast("string").alias("user_email"), F.col("id").alias("result_count"), F.col("created_at").alias("searched_at"))
    for _ in range(2):
        calls.coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    logged = J.run_to_files(search_log_stream(stream), str(tmp_path / "out2"), "append", str(tmp_path / "state2")).collect()
    assert sorted(r.result_count for r in logged) == [i for i in range(40) if i % 5] and {r.user_email for r in logged} == {"anonymous"}
