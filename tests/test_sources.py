"""The data source of parsed results, bucketed chunks, and tables in a relational database."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources import files as S
from quarry.sources.chunk_table import ChunkTable
from quarry.sources.parse import RESULT
from quarry.sources.parsed_source import read_results as load
from quarry.sources.parsed_source import write_results as save


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def results(spark, names, text="text"):
    rows = [(n, "failed" if n.endswith("x") else "success", "why" if n.endswith("x") else None, [] if n.endswith("x") else [(1, f"{text} {n} é", "text", None, False), (2, None, "ocr", 0.5, True)]) for n in names]
    return spark.createDataFrame(rows, RESULT)


def files_under(path):
    return sorted(f for d, _, names in os.walk(path) for f in names if f.endswith(".jsonl"))


def test_round_trip_with_a_mirror(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    first = results(spark, [f"f{i:03d}" for i in range(40)] + ["g1x"]).repartition(4)
    save(first, a, b)
    save(results(spark, ["late"]), a, b)
    want = sorted(map(str, first.union(results(spark, ["late"])).collect()))
    assert sorted(map(str, load(spark, a).collect())) == want == sorted(map(str, load(spark, b).collect()))
    save(results(spark, ["only"]), a, b, "overwrite")
    assert sorted(map(str, spark.read.format("parsed_results").load(a).collect())) == sorted(map(str, load(spark, b).collect()))
    assert [r.source_file for r in load(spark, a).collect()] == ["only"] == [r.source_file for r in load(spark, b).collect()]


def test_filters_skip_files(spark, tmp_path):
    path = str(tmp_path / "a")
    names = [f"f{i:03d}" for i in range(60)] + ["zx"]
    save(results(spark, names).repartitionByRange(6, "source_file"), path)
    found = load(spark, path).where("source_file = 'f010' AND status = 'success'")
    assert [r.source_file for r in found.collect()] == ["f010"]
    assert found.rdd.getNumPartitions() == 1 < load(spark, path).rdd.getNumPartitions()
    assert "Filter (" not in found._jdf.queryExecution().executedPlan().toString()
    assert load(spark, path).where("status = 'failed'").select("source_file").first()[0] == "zx"
    assert load(spark, path).where("source_file IN ('f001', 'zx', 'none')").count() == 2
    assert load(spark, path).where("error IS NULL AND source_file > 'f050'").count() == 9


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    save(results(spark, ["kept"]), a, b)
    before = files_under(tmp_path)
    bad = results(spark, [f"f{i}" for i in range(50)]).repartition(5).withColumn("status", F.when(F.col("source_file") == "f7", F.raise_error(F.lit("broken"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="broken"):
        save(bad, a, b)
    assert files_under(tmp_path) == before
    assert [r.source_file for r in load(spark, a).collect()] == ["kept"] == [r.source_file for r in load(spark, b).collect()]


def test_files_without_a_manifest_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "a")
    save(results(spark, ["kept"]), path)
    os.makedirs(f"{path}/lost")
    with open(f"{path}/lost/part-0.jsonl", "w") as f:
        f.write(json.dumps({"source_file": "lost", "status": "success"}) + "\n")
    assert [r.source_file for r in load(spark, path).collect()] == ["kept"]
    assert load(spark, str(tmp_path / "nothing")).collect() == []


# ---- chunks by bucket -----------------------------------------------------------------------------------------------


def chunk_rows(spark, docs, word):
    return spark.createDataFrame([(d * 100 + i, d, i, f"{word} {d} {i}") for d in docs for i in range(1 + d % 3)], "chunk_id long, doc_id long, chunk_idx int, text string")


def test_replace_and_join_by_bucket(spark, tmp_path):
    rng = random.Random(1)
    t = ChunkTable(spark, "chunk_table_test", str(tmp_path), parts=8, buckets=4).create(chunk_rows(spark, range(60), "old"))
    state = {d: "old" for d in range(60)}
    stamps = lambda: {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(tmp_path / "chunks") for f in (os.path.join(d, n) for n in names if n.startswith("part-"))}
    for turn in range(3):
        again, gone = rng.sample(range(70), 3), rng.sample(range(60), 2)
        gone = [g for g in gone if g not in again]
        before = stamps()
        t.replace(spark.createDataFrame([(g,) for g in gone], "doc_id long"), chunk_rows(spark, again, f"new{turn}"))
        state |= {d: f"new{turn}" for d in again}
        for g in gone:
            state.pop(g, None)
        want = sorted(tuple(r) for word in set(state.values()) for r in chunk_rows(spark, sorted(d for d, w in state.items() if w == word), word).collect())
        assert sorted(tuple(r) for r in t.chunks().select("chunk_id", "doc_id", "chunk_idx", "text").collect()) == want
        assert set(before.items()) & set(stamps().items()), "parts without a change keep their files"
    t.save(spark.createDataFrame([(d, f"n{d}") for d in range(70)], "doc_id long, name string"), "chunk_names_test", "names")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = t.chunks().join(spark.table("chunk_names_test"), "doc_id")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" in plan
        assert both.count() == t.chunks().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    t.replace(t.chunks().select("doc_id"), chunk_rows(spark, [1], "last"))
    assert {r.text for r in t.chunks().collect()} == {"last 1 0", "last 1 1"}
    spark.sql("DROP TABLE chunk_table_test")
    spark.sql("DROP TABLE chunk_names_test")


# ---- a relational database and backups -------------------------------------------------------------------------------


def test_relational_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    docs = spark.createDataFrame([(i, f"f{i}", None if i % 3 else i * 1.5) for i in range(100)], "id long, filename string, score double")
    S.upsert_jdbc(docs.repartition(3), url, "docs", ["id"], "filename VARCHAR(200)")
    S.upsert_jdbc(docs.where("id < 10").withColumn("filename", F.lit("again")).union(spark.createDataFrame([(500, "new", 1.0), (None, "no key", 1.0)], docs.schema)), url, "docs", ["id"], "filename VARCHAR(200)")
    S.upsert_jdbc(docs.where("id < 10").withColumn("filename", F.lit("again")), url, "docs", ["id"], "filename VARCHAR(200)")
    back = S.read_jdbc(spark, url, "docs", key="id", parts=4)
    assert back.rdd.getNumPartitions() == 4
    got = {r.id: (r.filename, r.score) for r in back.collect()}
    assert back.count() == 101 == len(got) and got[3] == ("again", 4.5) and got[50] == ("f50", None) and got[500] == ("new", 1.0)
    some = back.where("id >= 95 AND filename <> 'new'").select("filename")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(id,95)" in plan.replace(" ", "").replace("*", "") and "score" not in plan.split("ReadSchema")[1]
    assert sorted(r[0] for r in some.collect()) == [f"f{i}" for i in range(95, 100)]
    assert S.read_jdbc(spark, url, "docs", key="id", bounds=(0, 100)).count() == 101


def test_urls():
    assert S.jdbc_url("postgresql+asyncpg://h/d") == "jdbc:postgresql://h/d" == S.jdbc_url("postgres://h/d") and S.jdbc_url("jdbc:x:y") == "jdbc:x:y"


def test_backup_job_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path)
    tables = {"docs": spark.range(5), "users": spark.range(2)}
    for day in range(1, 17):
        gone = S.backup(spark, tables, path, f"202401{day:02d}", keep=14)
    assert gone == ["docs/backup_ts=20240102", "users/backup_ts=20240102"]
    assert S.backup(spark, tables, path, "20240116", keep=14) == []
    kept = S.snapshots(spark, path)
    assert kept.count() == 28 and kept.agg(F.min("name")).first()[0] == "backup_ts=20240103"
    assert spark.read.parquet(f"{path}/docs").groupBy("backup_ts").count().where("count = 5").count() == 14


def test_files_of_texts_and_of_results(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("é ok ".encode() + b"\xff\xfe end")
    assert [r.text for r in S.read_text(spark, str(tmp_path / "t")).collect()] == ["é ok  end"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps({"source_file": "a", "status": "success", "pages": [{"page_num": 4, "text": "x"}, {"page": 5, "text": "y", "flagged": True}]}, indent=1))
    (tmp_path / "r" / "2.json").write_text(json.dumps({"source_file": "b", "status": "failed", "error": "why"}))
    rows = {r.source_file: r for r in S.read_parsed(spark, str(tmp_path / "r")).collect()}
    assert [(p.page, p.text, p.flagged) for p in rows["a"].pages] == [(4, "x", False), (5, "y", True)] and rows["b"].pages == []


@pytest.mark.parametrize("message, shown", [("File is Encrypted", "the file has a password"), ("PDF syntax error: EOF", "the file is damaged"), ("odd " * 100, "the file can't be read: " + ("odd " * 100)[:200])])
def test_errors_that_users_see(message, shown):
    from quarry.sources.parse import readable_error

    assert readable_error(message) == shown
