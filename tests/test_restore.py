"""A whole restore, uploads beside what is there, and categories."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import lifecycle as L
from quarry.operators import restore as X

AS_OF = "2024-02-01 00:00:00"
DOC = "id long, filename string, saved_path string, category string, uploaded_at timestamp_ntz"


@pytest.fixture(scope="module")
def state(spark):
    docs = spark.createDataFrame([(i, f"f{i}.txt", f"in/f{i}.txt", "spec") for i in range(6)], "id long, filename string, saved_path string, category string").withColumn("uploaded_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    comments = spark.createDataFrame([(10 + i, i % 6, f"u{i}@ex.com", f"said {i}") for i in range(12)], "id long, doc_id long, user_email string, content string")
    marks = spark.createDataFrame([(i, "u1@ex.com") for i in range(6)], "doc_id long, user_email string").withColumn("created_at", F.lit("2024-01-02").cast("timestamp_ntz"))
    grants = spark.createDataFrame([(2, "u9@ex.com"), (4, "u9@ex.com")], "doc_id long, user_email string")
    chunks = spark.createDataFrame([(i, k, 1, f"chunk {i} {k}", [float(i), k / 3]) for i in range(6) for k in range(2)], "doc_id long, chunk_idx int, page_num long, text string, embedding array<float>")
    return docs, comments, marks, grants, chunks


def test_everything_comes_back(spark, state):
    docs, comments, marks, grants, chunks = state
    snaps = L.trash_snapshot(docs, comments, marks, grants)
    # 2 is gone; 3 is gone, but its id and its path are another document's; 4 was restored already.
    live = docs.where("id IN (0, 1, 5)").union(docs.where("id = 3").withColumns({"filename": F.lit("other.txt")}))
    logs = spark.createDataFrame([(100, 2, "trashed", "t/2"), (101, 3, "trashed", "t/3"), (102, 4, "restored", "t/4"), (103, 5, "purged", "t/5"), (104, 2, "trashed", "t/2")], "id long, doc_id long, status string, trash_dir string")
    logs = logs.withColumn("deleted_at", F.when(F.col("id") == 104, "2024-01-20").otherwise("2024-01-25").cast("timestamp_ntz")).join(snaps, "doc_id")
    kept = X.trash_chunks(chunks, spark.createDataFrame([(2,), (3,)], "id long"))
    here = lambda df: df.join(live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    # An orphan is left under the id that comes back.
    orphans = comments.limit(0).union(spark.createDataFrame([(99, 2, "ghost@ex.com", "orphan")], comments.schema))
    tables = {"documents": live, "comments": here(comments).unionByName(orphans), "bookmarks": here(marks), "permissions": here(grants), "chunks": here(chunks)}
    wanted = spark.createDataFrame([(i,) for i in (100, 101, 102, 103, 104, 555, 100)], "id long")
    after = X.restore(wanted, logs, kept, tables, AS_OF, "root@ex.com")
    assert {r.id: r.verdict for r in after["verdicts"].collect()} == {100: 200, 101: 200, 102: 409, 103: 410, 104: 409, 555: 404}
    assert {r.id: (r.filename, r.saved_path) for r in after["documents"].where("id NOT IN (0, 1, 5)").collect()} == {
        2: ("f2.txt", "in/f2.txt"),
        3: ("other.txt", "in/f3.txt"),
        6: ("f3.txt", "in/f3_restored_101.txt"),
    }
    said = {r.doc_id: sorted(x.content for x in after["comments"].where(F.col("doc_id") == r.doc_id).collect()) for r in after["comments"].select("doc_id").distinct().collect()}
    assert said[2] == ["said 2", "said 8"] and said[6] == ["said 3", "said 9"] == said[3]
    assert after["bookmarks"].where("doc_id IN (2, 6)").count() == 2 and after["permissions"].where("doc_id = 2").first().user_email == "u9@ex.com"
    vectors = {(r.doc_id, r.chunk_idx): r.embedding for r in after["chunks"].collect()}
    want = {(r.doc_id, r.chunk_idx): r.embedding for r in chunks.collect()}
    assert vectors[6, 1] == want[3, 1] == vectors[3, 1] and vectors[2, 0] == want[2, 0] and len(vectors) == 12
    done = {r.id: r for r in after["logs"].collect()}
    assert (done[101].status, done[101].restored_doc_id, done[101].restored_by, done[101].snapshot) == ("restored", 6, "root@ex.com", None)
    assert done[104].status == "trashed" and done[104].snapshot and str(done[100].restored_at).startswith("2024-02-01")


def test_uploads_take_no_place(spark):
    docs = spark.createDataFrame([(1, "a.txt", None, "s1"), (2, "a.txt", None, "s2"), (3, "x", "dir/b.txt", "s1")], "id long, filename string, original_path string, sha256 string").withColumn("uploaded_at", F.col("id").cast("timestamp").cast("timestamp_ntz"))
    users = spark.createDataFrame([("u@ex.com", "rnd")], "email string, department string")
    up = spark.createDataFrame([(10, "a.txt", None, "s1", "u@ex.com"), (11, "a.txt", "../a.txt", "s9", "u@ex.com"), (12, "b.txt", "dir/b.txt", None, "who"), (13, "new.txt", None, "s2", None)], "id long, filename string, original_path string, sha256 string, uploaded_by string")
    got = {r.id: r for r in X.insert_uploads(up, docs, users, AS_OF).collect()}
    assert {i: r.saved_path for i, r in got.items()} == {10: "a (3).txt", 11: "a (4).txt", 12: "dir/b (2).txt", 13: "new.txt"}
    assert {i: r.duplicate_of for i, r in got.items()} == {10: 3, 11: None, 12: None, 13: 2}
    assert got[10].department == "rnd" and got[12].department is None and {r.status for r in got.values()} == {"parsing"}


def test_categories_go_when_empty(spark, state):
    names = spark.createDataFrame([("spec",), ("none",), ("none",), (None,)], "name string")
    assert {r.name: r.verdict for r in X.category_verdicts(state[0], names).collect()} == {"spec": 409, "none": 200, None: 200}


def test_verdicts_carry_no_snapshots(spark, state):
    docs, comments, marks, grants, chunks = state
    snaps = L.trash_snapshot(docs, comments, marks, grants)
    logs = spark.createDataFrame([(100 + i, i, "trashed", "t") for i in range(3)], "id long, doc_id long, status string, trash_dir string").withColumn("deleted_at", F.lit("2024-01-25").cast("timestamp_ntz"))
    logs = logs.join(snaps, "doc_id").localCheckpoint()
    after = X.restore(logs.select("id"), logs, X.trash_chunks(chunks, docs), {"documents": docs, "comments": comments, "bookmarks": marks, "permissions": grants, "chunks": chunks}, AS_OF, "root@ex.com")
    plan = after["verdicts"]._jdf.queryExecution().optimizedPlan().toString()
    assert {r.verdict for r in after["verdicts"].collect()} == {200}
    # What joins and windows move: the rows above the projections that read the logs.
    moved = [line for line in plan.splitlines() if "snapshot" in line and not line.lstrip(" :+-").startswith(("Project", "LogicalRDD"))]
    above = plan[: plan.rindex("Join")]
    assert not moved and "snapshot" not in above


def test_restore_builds_no_search_index(spark, monkeypatch):
    from quarry.plans import queries as Q
    from quarry.sources.index import SearchIndex

    def refuse(*_):
        raise AssertionError("a restore searches nothing")

    monkeypatch.setattr(Q, "_BUILT", {})
    monkeypatch.setattr(SearchIndex, "add", refuse)
    out = Q.QUERIES["restore_documents"](spark, "/root/testdata/sf0.001")
    assert all(r.n_chunks >= 0 for r in out.collect())
    # What is restored was written once; no table's plan works it out again.
    assert "InMemoryRelation" not in out._jdf.queryExecution().withCachedData().toString()
