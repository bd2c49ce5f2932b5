import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import admin as A
from quarry.operators import chunking as C
from quarry.operators import documents as D
from quarry.operators import lifecycle as L
from quarry.operators import search as S
from quarry.sources import files as FS
from quarry.sources import hwp5 as H
from quarry.sources import parse as P
from quarry.sources import pdf as PDF
from quarry.sources.compound import SIGNATURE
from quarry.streaming import jobs as J

# ---- chunks -------------------------------------------------------------------------------------------


def test_sections_drop_what_stands_before_the_first_heading():
    text = "preamble\n# One\nbody one\n## Two\nbody two\n1.2. Three\nbody\n제 3 장 넷\n끝"
    got = [c for _, _, c in C.spans(text)]
    assert got == ["# One\nbody one", "## Two\nbody two", "1.2. Three\nbody", "제 3 장 넷\n끝"]
    assert [c for _, _, c in C.spans("preamble\n# One\nbody")] == ["preamble\n# One\nbody"]


@pytest.mark.parametrize("n, sizes", [(399, [399]), (400, [400]), (401, [400, 81]), (480, [400, 160]), (1000, [400, 400, 360])])
def test_windows_of_a_text_without_boundaries(n, sizes):
    assert [len(c) for _, _, c in C.spans("x" * n)] == sizes


def test_boundaries_by_rank_not_by_place():
    text = "a" * 320 + "\n" + "b" * 30 + ". " + "c" * 300
    first = next(C.spans(text))
    assert (first[0], first[1]) == (0, 321) and first[2] == "a" * 320


def test_places_ignore_stripped_space():
    (start, end, chunk), *rest = C.spans("   hello there")
    assert (start, end, chunk) == (0, len("hello there"), "hello there") and not rest
    assert list(C.spans("  \n ")) == [] and list(C.spans(None)) == []


def test_pages_flagged_and_blank_are_left_out(spark):
    schema = "doc_id long, pages array<struct<page: int, text: string, flagged: boolean>>"
    pages = [(1, "first page with some words", False), (2, "bad words on a flagged page", True), (3, "  ", False), (4, "fourth page with words", False)]
    docs = spark.createDataFrame([(1, pages), (2, [(1, "", False)])], schema)
    joined = C.joined_pages(docs).collect()
    assert len(joined) == 1 and joined[0].text == "first page with some words\nfourth page with words"
    assert [(o.off, o.page) for o in joined[0].offsets] == [(0, 1), (27, 4)]
    at = C.joined_pages(docs).select(*[C.page_at(F.col("offsets"), F.lit(x)).alias(f"p{x}") for x in (0, 26, 27, 99)]).first()
    assert tuple(at) == (1, 1, 4, 4)
    long = [(1, "a" * 390, False), (2, "b" * 19, False)]
    got = C.page_chunks(spark.createDataFrame([(1, long)], schema)).collect()
    assert [r.page_num for r in got] == [1, 1]


def test_snippets_take_the_densest_window():
    text = "needle " + "x" * 300 + " needle other needle " + "y" * 300
    assert C.snippet(text, ["needle", "other"]).count("needle") == 2
    assert C.snippet("needle " + "x" * 490, ["needle"]) == "needle " + "x" * 133 + "…"
    assert C.snippet("  " + "x" * 300, []) == "x" * 200 + "…" and C.snippet("short", ["zz"]) == "short"


def test_titles(spark):
    rows = [["abc\n" + "x" * 121 + "\n12 - 3\n목차\n  A valid title  \nmore"], ["Table of  Contents\nINDEX"], ["one", "two", "tri", "a fourth page"]]
    df = spark.createDataFrame([(r,) for r in rows], "pages array<string>")
    assert [r[0] for r in df.select(T.title_of(F.col("pages"))).collect()] == ["A valid title", "", ""]


def test_tokens(spark):
    df = spark.createDataFrame([("모터 설계-사양 1.8V",), ("The 1.8V rail at 0x60 and 200MHz the_rail",), ("a of",)], "t string")
    assert df.select(T.terms(F.col("t"), 2)).first()[0] == ["모터", "설계", "사양", "8v"]
    assert [r[0] for r in df.select(T.english_tokens(F.col("t"))).collect()] == [["1.8v"], ["rail", "x60", "mhz", "the_rail", "1.8v", "0x", "200mhz", "0x60"], ["a", "of"]]
    assert S.query_terms("얼마 모터 Motor motor") == ["모터", "motor"]


def test_confidence_and_flags(spark):
    blocks = spark.createDataFrame([(1, "x" * 21, 0.83), (1, "y" * 9, 0.54), (2, "", 0.9)], "page_id long, text string, conf double")
    assert {r.page_id: r.confidence for r in C.weighted_confidence(blocks).collect()} == {1: 0.743, 2: 0.0}
    scores = spark.createDataFrame([(1, None, 0.3), (2, None, 0.8), (3, 0.4, 0.3), (4, float("nan"), 0.79)], "page_id long, parse_score double, ocr_score double")
    assert {r.page_id: (r.flagged, r.reread) for r in C.page_flags(scores).collect()} == {1: (True, False), 2: (False, False), 3: (False, True), 4: (True, False)}
    boxes = spark.createDataFrame([([(0.0, 0.0, 2.0, 2.0)],)], "t array<struct<x0: double, y0: double, x1: double, y1: double>>")
    assert tuple(boxes.select(C.inside_any(F.col("t"), F.lit(1.0), F.lit(2.0)), C.inside_any(F.col("t"), F.lit(3.0), F.lit(1.0))).first()) == (True, False)


def test_grids(spark):
    cells = [(1, 0, 0, 0, "a|b"), (1, 0, 0, 1, "c"), (1, 1, 2, 2, "d\ne"), (2, 0, 0, 0, " ")]
    df = spark.createDataFrame(cells, "table_id long, row int, col int, place long, text string")
    assert {r.table_id: r.markdown for r in C.grid_markdown(df).collect()} == {1: "| a\\|b c |  |  |\n| --- | --- | --- |\n|  |  | d e |", 2: ""}
    assert P.markdown([(0, 0, "a|b"), (0, 0, "c"), (1, 2, "d\ne")]) == "| a\\|b c |  |  |\n| --- | --- | --- |\n|  |  | d e |"


# ---- access, search ---------------------------------------------------------------------------------------


def test_access(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")], "id long, department string")
    grants = spark.createDataFrame([(2, "me"), (4, "you"), (2, "you")], "doc_id long, user_email string")
    ids = lambda *a, **k: {r.id for r in D.readable(docs, grants, *a, **k).collect()}
    assert ids("me", "b") == {2, 3, 5} and ids("you", "a") == {1, 2, 3, 4} and ids("x", None) == {3} and ids("x", None, admin=True) == {1, 2, 3, 4, 5}


def test_days_that_cant_be_read_are_ignored(spark):
    docs = spark.createDataFrame([(1, "success", "2024-01-04 23:59:59"), (2, "success", "2024-01-05 10:00:00"), (3, "failed", "2024-01-05 10:00:00")], "id long, status string, at string")
    docs = docs.withColumn("uploaded_at", F.col("at").cast("timestamp_ntz"))
    ids = lambda **k: {r.id for r in D.visible(docs, **k).collect()}
    assert ids(date_from="2024-01-05") == {2} and ids(date_to="2024-01-04") == {1} and ids(date_from="2024-13-01", date_to="") == {1, 2}


def test_fusion_gates_and_missing_ranks(spark):
    hits = lambda rows: spark.createDataFrame(rows, "chunk_id long, doc_id long, score double")
    bm, near = hits([(10, 1, 3.0), (20, 2, 2.0)]), hits([(21, 2, 0.9), (22, 2, 0.8), (30, 3, 0.79), (40, 4, 0.75)])
    got = {r.doc_id: r for r in S.hybrid(bm, near).collect()}
    assert set(got) == {1, 2, 3}  # 4 is below the strong gate
    assert got[1].raw == pytest.approx(1 / (30 + 4) + 1 / 61) and got[3].raw == pytest.approx(1 / 32 + 1 / 64)
    assert got[2].chunk_id == 21 and got[1].chunk_id == 10
    alone = {r.doc_id for r in S.hybrid(bm.limit(0), near).collect()}
    assert alone == {2, 3, 4} and S.hybrid(bm.limit(0), near.limit(0)).collect() == []
    old = {r.chunk_id: r.score for r in S.hybrid_old(bm, near).collect()}
    assert old[10] == pytest.approx(1 / 31) and old[21] == pytest.approx(1 / 61)


def test_query_terms_of_the_other_language(spark):
    df = spark.createDataFrame([("Low Temperature margin",), ("음수 슬랙",), ("nothing",)], "q string")
    assert [r[0] for r in df.select(S.augmented(F.col("q"))).collect()] == ["Low Temperature margin 저온 온도 마진", "음수 슬랙 negative slack", "nothing"]


def test_retrieval_ranks(spark):
    results = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c")], "query_id long, place long, name string")
    targets = spark.createDataFrame([(1, "b"), (2, "x")], "query_id long, name string")
    ranks = S.first_ranks(results, targets)
    assert {r.query_id: r.rank for r in ranks.collect()} == {1: 2, 2: None}
    out = S.retrieval_metrics(ranks.withColumn("kind", F.lit("k")), ["kind"]).collect()
    assert {(r.kind, r.n, r.hit1, r.hit5, r.mrr10) for r in out} == {(None, 2, 0.0, 0.5, 0.25), ("k", 2, 0.0, 0.5, 0.25)}


# ---- lifecycle ------------------------------------------------------------------------------------------------


def test_upserts_and_absent_rows(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    assert {tuple(r) for r in L.upsert(base, changes, ["id"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert {tuple(r) for r in L.insert_absent(base, changes.union(changes), ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "C")}


def test_restore_verdicts(spark):
    rows = [(1, "restored", "2024-01-30"), (2, "trashed", "2024-01-10"), (3, "trashed", "2023-12-01"), (4, None, "2024-01-10"), (5, "purged", "2024-01-10")]
    rows += [(6, "trashed", "2024-01-01"), (7, "trashed", "2024-01-01 00:00:01"), (8, "trashed", "2024-01-10"), (9, "trashed", "2024-01-10")]
    logs = spark.createDataFrame(rows, "id long, status string, at string").selectExpr(
        "id", "id AS doc_id", "status", "CAST(at AS TIMESTAMP_NTZ) AS deleted_at", "'f' AS filename", "CASE WHEN id = 8 THEN NULL ELSE '[]' END AS snapshot", "CASE WHEN id = 9 THEN '' ELSE 'd' END AS trash_dir"
    )
    wanted = spark.createDataFrame([(i,) for i in range(1, 11)], "id long")
    # Thirty days on the second are over, one second less is not.
    want = {1: 409, 2: 200, 3: 410, 4: 410, 5: 410, 6: 410, 7: 200, 8: 410, 9: 410, 10: 404}
    assert {r.id: r.verdict for r in L.restore_verdict(wanted, logs, "2024-01-31 00:00:00").collect()} == want
    states = {r.id: r.state for r in L.log_states(logs, "2024-01-31 00:00:00").collect()}
    assert {k: states[k] for k in range(1, 8)} == {1: "restored", 2: "trashed", 3: "purged", 4: "legacy", 5: "purged", 6: "purged", 7: "trashed"}
    purged = {r.id: (r.status, r.snapshot) for r in L.purge_logs(logs, "2024-01-31 00:00:00").collect()}
    assert purged[3] == ("purged", None) and purged[6] == ("trashed", "[]")


def test_uploads(spark):
    rows = [("", 1, 1), ("a.exe", 1, 1), ("a.pdf", 600 << 20, 1), ("a.txt", 200 << 20, 1), ("a.pdf", 1, 3001), ("A.HWPX", 1, 3)]
    df = spark.createDataFrame(rows, "name string, length long, page_count int")
    why = [r.error for r in FS.upload_errors(df).collect()]
    assert [w is None for w in why] == [False] * 5 + [True] and why[2] == "600.0 MB is over 500 MB"
    paths = spark.createDataFrame([(1, "../a/./b.txt"), (2, "a/b.txt"), (3, "/a/b.txt"), (4, "a\\..\\c")], "id long, path string")
    assert [r.saved_path for r in FS.free_names(paths, [F.col("id")]).orderBy("id").collect()] == ["a/b.txt", "a/b (2).txt", "a/b (3).txt", "a/c"]


def test_relative_dates(spark):
    ago = {0: "방금 전", 59: "방금 전", -5: "방금 전", 60: "1분 전", 3599: "59분 전", 3600: "1시간 전", 86399: "23시간 전", 86400: "1일 전", 604799: "6일 전", 604800: "2024.01.24", 9_000_000: "2023.10.19"}
    df = spark.createDataFrame([(s,) for s in ago], "s long").select("s", (F.lit("2024-01-31 12:00:00").cast("timestamp") - F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))).alias("at"))
    assert {r.s: r.x for r in df.select("s", T.relative_date(F.col("at"), F.lit("2024-01-31 12:00:00").cast("timestamp")).alias("x")).collect()} == ago
    none = spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS at")
    assert none.select(T.relative_date(F.col("at"), F.lit("2024-01-31").cast("timestamp"))).first()[0] == ""


def test_highlights_words_in_the_query_s_order(spark):
    df = spark.createDataFrame([("ÄB ab abc a.c É",)], "t string")
    mark = lambda q: df.select(T.highlight(F.col("t"), q)).first()[0]
    assert mark("ab abc") == "ÄB <mark>ab</mark> <mark>ab</mark>c a.c É"
    assert mark("abc ab") == "ÄB <mark>ab</mark> <mark>abc</mark> a.c É"
    assert mark(" äb  é a.c") == "<mark>ÄB</mark> ab abc <mark>a.c</mark> <mark>É</mark>" and mark("  ") == "ÄB ab abc a.c É"


def test_okapi_counts_repeated_tokens_and_chunks_without_terms(spark):
    chunks = spark.createDataFrame([(1, "rare common"), (2, "common other"), (3, "more words"), (4, "")], "chunk_id long, text string").selectExpr("*", "chunk_id AS doc_id")
    index = S.postings(chunks, ("text",))
    score = lambda q, n=None: {r.chunk_id: r.score for r in S.okapi(index, q, S.okapi_stats(index, n)).collect()}
    once, twice = score(["rare"]), score(["rare", "rare"])
    assert set(once) == {1} and twice[1] == pytest.approx(2 * once[1], abs=2e-6)
    assert S.okapi_stats(index, 4).first().n == 4 and S.okapi_stats(index).first().n == 3 and score(["rare"], 4) != once


def test_roles_and_deletes(spark):
    admins = A.admin_set([" Boss@x ", ""], spark.createDataFrame([("Me@x",), (None,)], "email string"))
    assert {r.email for r in admins.collect()} == {"boss@x", "me@x"}
    who = spark.createDataFrame([("BOSS@x",), ("you@x",), (None,)], "email string")
    assert [r.is_admin for r in A.with_admin(who, "email", admins).orderBy("email").collect()] == [False, True, False]
    assert all(r.is_admin for r in A.with_admin(who, "email", admins, login=False).collect())
    comments = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, None)], "id long, doc_id long, user_email string")
    asked = spark.createDataFrame([(10, 1, "a", False), (10, 2, "a", False), (10, 2, "c", True), (11, 1, "a", True), (11, 3, None, False)], "doc_id long, comment_id long, user_email string, is_admin boolean")
    verdicts = A.comment_verdicts(asked, comments)
    assert sorted((r.comment_id, r.verdict) for r in verdicts.collect()) == [(1, 200), (1, 404), (2, 200), (2, 403), (3, 403)]
    assert [r.id for r in A.without_granted(comments, "id", verdicts, "comment_id").collect()] == [3]
    docs = spark.createDataFrame([(1, "f", "c"), (2, "g", "c")], "id long, filename string, category string")
    left, log = A.bulk_delete(docs, spark.createDataFrame([(1,), (1,), (9,)], "doc_id long"), " why ", "me", "2024-01-31 00:00:00")
    assert [r.id for r in left.collect()] == [2] and [(r.doc_id, r.reason) for r in log.collect()] == [(1, "why")]
    with pytest.raises(ValueError):
        A.bulk_delete(docs, docs.selectExpr("id AS doc_id"), "  ", "me", "2024-01-31 00:00:00")


def test_page_edits(spark):
    schema = "doc_id long, pages array<struct<page: int, text: string, flagged: boolean>>"
    parsed = spark.createDataFrame([(1, [(1, "a", True), (2, "b", True), (2, "c", False)]), (2, [(1, "a", None)]), (3, [])], schema)
    edits = spark.createDataFrame([(1, 2, "new"), (2, 5, "x"), (3, 1, "y")], "doc_id long, page long, text string")
    got = {r.doc_id: r for r in A.edit_pages(parsed, edits).collect()}
    assert [(p.text, p.flagged) for p in got[1].pages] == [("a", True), ("new", False), ("c", False)] and got[1].has_flagged and got[1].verdict == 200
    assert got[2].verdict == got[3].verdict == 404 and not got[2].has_flagged


def test_exports_are_read_back(spark, tmp_path):
    row = spark.createDataFrame([(1, 'a "b".pdf', "pdf", None, "spec", "parsing", 3, True, "2024-01-05 10:00:00")], "id long, filename string, file_type string, original_path string, category string, status string, page_count int, has_flagged boolean, at string")
    FS.write_csv(row.coalesce(1).withColumn("uploaded_at", F.col("at").cast("timestamp_ntz")), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes().decode("utf-8-sig").splitlines()
    assert text[0] == ",".join(FS.EXPORT) and "사양서,실패,3,검토필요,2024-01-05 10:00:00" in text[1]


def test_mixed_tokens(spark):
    df = spark.createDataFrame([("모터 설계 1.8V NFC_CTRL 값",), ("only English words",), ("가 나",)], "t string")
    assert [r[0] for r in df.select(T.legacy_tokens(F.col("t"))).collect()] == [["모터", "설계", "nfc_ctrl", "1.8v"], ["english", "words"], ["가", "나"]]
    assert df.select(T.legacy_query_tokens(F.col("t"))).first()[0] == ["모터", "설계", "nfc_ctrl", "1.8v"]
    assert [tuple(r) for r in df.select(T.find(F.col("t"), "l"), T.rfind(F.col("t"), "l"), T.rfind(F.col("t"), "lis")).collect()][1] == (2, 8, 8)


def test_backups_are_fetched_and_deleted_by_name(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(b"one")
    (tmp_path / "b.tar").write_bytes(b"two")
    path = "file://" + str(tmp_path)
    assert [bytes(r.content) for r in FS.fetch_backup(spark, path, "a.tar").collect()] == [b"one"]
    assert FS.fetch_backup(spark, path, "../a.tar").collect() == []
    assert not FS.delete_backup(spark, path, "../b.tar") and FS.delete_backup(spark, path, "b.tar") and not FS.delete_backup(spark, path, "b.tar")
    assert [r.name for r in FS.list_backups(spark, path).collect()] == ["a.tar"]


def test_pages_of_a_pdf(spark):
    page = b"1 0 obj <</Type /Page /Parent 2 0 R>> endobj\n"
    packed = zlib.compress(b"5 0 6 20 <</Type/Page>> <</Type/Page /X 1>> <</Type /Pages /Count 9>>")
    stream = b"3 0 obj <</Type /ObjStm /Length %d /Filter /FlateDecode>> stream\n" % len(packed) + packed + b"\nendstream endobj\n"
    text = b"4 0 obj <</Length 12>> stream\n/Type /Page \nendstream endobj\n"
    assert PDF.page_count(b"%PDF-1.5\n" + page + b"<</Type /Pages>>" + stream + text + page) == 4
    assert PDF.page_count(b"none") is None and PDF.page_count(b"%PDF-1.4\n") == 0
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.5\n" + page)), ("b", bytearray(b"x"))], "path string, content binary")
    assert {r.path: r.page_count for r in PDF.page_counts(files).collect()} == {"a": 1, "b": None}


def test_coded_vectors_find_most_of_the_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(400, 48)))]
    vectors = spark.createDataFrame(rows + [(400, 400, [0.5] * 48)], "chunk_id long, doc_id long, embedding array<float>")
    exact = {r.chunk_id for r in S.knn(vectors, rows[7][2], 20).collect()}
    got = {r.chunk_id for r in S.knn_coded(S.coded(vectors), rows[7][2], 20).collect()}
    assert len(got) == 20 and len(exact & got) >= 18
    assert S.knn_coded(S.coded(vectors), rows[7][2], 1000).count() == 401


# ---- parsing ----------------------------------------------------------------------------------------------------


def hwpx(*sections):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, body in enumerate(sections):
            z.writestr(f"Contents/section{i}.xml", f'<hs:sec xmlns:hs="s" xmlns:hp="p">{body}</hs:sec>')
    return out.getvalue()


def test_hwpx():
    cell = lambda r, c, t: f'<hp:tc><hp:cellAddr rowAddr="{r}" colAddr="{c}"/><hp:p><hp:run><hp:t>{t}</hp:t></hp:run></hp:p></hp:tc>'
    inner = f'<hp:tbl rowCnt="1" colCnt="1"><hp:tr>{cell(0, 0, "in")}</hp:tr></hp:tbl>'
    table = f'<hp:tbl rowCnt="2" colCnt="2"><hp:tr>{cell(0, 0, "a")}{cell(0, 1, "b|c")}</hp:tr><hp:tr>{cell(1, 1, "d")}<hp:tc><hp:cellAddr rowAddr="1" colAddr="0"/>{inner}</hp:tc></hp:tr></hp:tbl>'
    body = f"<hp:p><hp:run><hp:t>one<hp:tab/>two</hp:t></hp:run><hp:run>{table}<hp:t>after</hp:t></hp:run></hp:p>"
    got = P.parse("x.hwpx", hwpx(body, "<hp:p/>"))
    assert got["status"] == "success" and [p["page"] for p in got["pages"]] == [1]
    assert got["pages"][0]["text"] == "one\ttwo\n\n| a | b\\|c |\n| --- | --- |\n| in | d |\n\nafter"
    assert P.parse("x.hwpx", b"no zip")["status"] == "failed" and P.parse("x.hwpx", hwpx("<hp:p/>"))["status"] == "failed"


def record(tag, level, payload):
    size = len(payload)
    head = tag | level << 10 | min(size, 0xFFF) << 20
    return struct.pack("<I", head) + (struct.pack("<I", size) if size >= 0xFFF else b"") + payload


def utf16(text):
    return text.encode("utf-16-le")


def compound(streams):
    """A small compound file: every stream is long enough to stand in normal sectors."""
    names = [("Root Entry", 5, 1, None)] + [(n, k, c, d) for n, k, c, d in streams]
    sectors, entries = [], []
    for name, kind, child, data in names:
        start = 0xFFFFFFFE
        if data is not None:
            start = len(sectors)
            padded = data.ljust(max(4096, -(-len(data) // 512) * 512), b"\0")
            parts = [padded[i : i + 512] for i in range(0, len(padded), 512)]
            sectors += [(p, len(sectors) + i + 1 if i + 1 < len(parts) else 0xFFFFFFFE) for i, p in enumerate(parts)]
        entries.append((name, kind, child, start, max(4096, len(data)) if data is not None else 0))
    raw = b""
    for i, (name, kind, child, start, size) in enumerate(entries):
        nm = utf16(name) + b"\0\0"
        right = child[1] if isinstance(child, tuple) else 0xFFFFFFFF
        kid = child[0] if isinstance(child, tuple) else child
        raw += nm.ljust(64, b"\0") + struct.pack("<HBBIII", len(nm), kind, 1, 0xFFFFFFFF, right, kid if kid is not None else 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size)
    raw = raw.ljust(-(-len(raw) // 512) * 512, b"\0")
    first_dir = len(sectors)
    blocks = [raw[i : i + 512] for i in range(0, len(raw), 512)]
    sectors += [(b, first_dir + i + 1 if i + 1 < len(blocks) else 0xFFFFFFFE) for i, b in enumerate(blocks)]
    n_fat = -(-(len(sectors) + 1) // 127)
    fat = [x for _, x in sectors] + [0xFFFFFFFD] * n_fat
    fat += [0xFFFFFFFF] * (n_fat * 128 - len(fat))
    difat = [len(sectors) + i for i in range(n_fat)] + [0xFFFFFFFF] * (109 - n_fat)
    head = SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, n_fat, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", *difat)
    return head + b"".join(s for s, _ in sectors) + struct.pack(f"<{len(fat)}I", *fat)


def hwp(bits, body):
    header = b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", bits)
    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = packed.compress(body) + packed.flush() if bits & H.COMPRESSED else body
    return compound([("FileHeader", 2, (None, 2), header), ("BodyText", 1, 3, None), ("Section0", 2, None, data)])


def test_hwp():
    control = H.TABLE_CONTROL.to_bytes(4, "little")
    cell = lambda r, c: record(H.LIST_HEADER, 2, b"\0" * 8 + struct.pack("<HH", c, r))
    body = record(H.PARA_TEXT, 1, utf16("Hello\u0009" + "\0" * 7 + "there\u000a" + "x" * 5000 + "\u001e" + "y"))
    body += record(H.CTRL_HEADER, 1, control) + record(H.TABLE, 2, b"\0" * 4 + struct.pack("<HH", 1, 2))
    body += cell(0, 0) + record(H.PARA_TEXT, 3, utf16("left")) + cell(0, 1) + record(H.PARA_TEXT, 3, utf16("right"))
    body += record(H.PARA_TEXT, 1, utf16("end"))
    got = P.parse("a.hwp", hwp(H.COMPRESSED, body.ljust(5000, b"\0")))
    assert got["status"] == "success", got["error"]
    text = got["pages"][0]["text"]
    assert text.startswith("Hello\tthere\n") and "x y" in text and "| left | right |\n| --- | --- |\n\nend" in text
    assert "password" in P.parse("a.hwp", hwp(H.PASSWORD, body))["error"] and "distribution" in P.parse("a.hwp", hwp(H.DISTRIBUTION, body))["error"]
    assert P.parse("a.hwp", b"junk")["status"] == "failed"


def test_one_bad_file_is_one_failed_row(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode() + b"\xff!")
    (tmp_path / "b.hwpx").write_bytes(b"junk")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.source_file: r for r in P.parsed(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.txt"].pages[0].text == "café!" and got["b.hwpx"].status == got["c.pdf"].status == "failed"
    own = {"pdf": lambda name, data: P.succeeded(name, "own", [["text"]])}
    assert {r.status for r in P.parsed(spark.read.format("binaryFile").load(str(tmp_path / "c.pdf")), own).collect()} == {"success"}


# ---- streams ------------------------------------------------------------------------------------------------------


def test_the_sliding_log_forgets_refused_requests():
    times = [i / 10 for i in range(181)] + [60.5, 61.0]
    ok, log = J.allowed_times(times, [])
    assert ok[:180] == [True] * 180 and ok[180:] == [False, True, True] and len(log) <= 180


def test_limiter_and_ingest_as_streams(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("k", f"2024-01-01 00:00:{i:02d}") for i in range(5)], "key string, at string").selectExpr("key", "CAST(at AS TIMESTAMP) AS at").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(source))
    rows = J.run_to_files(J.limited(stream, window=3, most=2, expire=False), str(tmp_path / "o1"), "append", str(tmp_path / "c1")).orderBy("at").collect()
    assert [r.allowed for r in rows] == [True, True, False, False, True]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("some text")
    J.ingest(spark, str(tmp_path / "files"), out, str(tmp_path / "c2")).awaitTermination(60)
    assert [r.status for r in spark.read.parquet(out).collect()] == ["success"]


# ---- Office files -------------------------------------------------------------------------------------------------


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A_NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P_NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
R_NS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def rels(*targets):
    return RELS.format("".join(f'<Relationship Id="rId{i}" Target="{t}"/>' for i, t in enumerate(targets, 1)))


def test_docx():
    p = lambda t: f"<w:p><w:pPr/><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, span="": f"<w:tc><w:tcPr>{span}</w:tcPr>{p(t)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("a", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}{cell("b|c")}</w:tr><w:tr>{cell("1")}{cell("2")}{cell("3")}</w:tr></w:tbl>'
    body = f"{p('One')}{table}<w:sdt><w:sdtContent>{p('Two')}</w:sdtContent></w:sdt><w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>"
    got = P.parse("x.docx", package({"word/document.xml": f"<w:document {W_NS}><w:body>{body}</w:body></w:document>"}))
    assert got["status"] == "success" and got["pages"][0]["page"] == 1
    assert got["pages"][0]["text"] == "One\nTwo\nx\ty\n| a |  | b\\|c |\n| --- | --- | --- |\n| 1 | 2 | 3 |"
    assert P.parse("x.docx", b"none")["status"] == P.parse("x.docx", package({"a": "b"}))["status"] == "failed"


def test_pptx_slides_in_their_order():
    slide = lambda t, more="": f"<p:sld {P_NS} {A_NS}><p:cSld><a:p><a:r><a:t>{t}</a:t></a:r></a:p>{more}</p:cSld></p:sld>"
    table = "<a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl>"
    parts = {
        "ppt/presentation.xml": f'<p:presentation {P_NS} {R_NS}><p:sldIdLst><p:sldId r:id="rId2"/><p:sldId r:id="rId3"/><p:sldId r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels("slides/slide1.xml", "/ppt/slides/slide2.xml", "slides/slide3.xml"),
        "ppt/slides/slide1.xml": slide("last", table),
        "ppt/slides/slide2.xml": slide("first"),
        "ppt/slides/slide3.xml": slide(" "),
    }
    got = P.parse("x.pptx", package(parts))
    assert [(p["page"], p["text"]) for p in got["pages"]] == [(1, "first"), (3, "last\n| k | v |\n| --- | --- |")]


def test_xlsx_sheets():
    sheet = lambda rows: f"<worksheet {S_NS}><sheetData>{rows}</sheetData></worksheet>"
    parts = {
        "xl/workbook.xml": f'<workbook {S_NS} {R_NS}><sheets><sheet name="B" r:id="rId2"/><sheet name="A" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels("worksheets/sheet1.xml", "worksheets/sheet2.xml"),
        "xl/sharedStrings.xml": f"<sst {S_NS}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r><rPh><t>x</t></rPh></si></sst>",
        "xl/worksheets/sheet1.xml": sheet('<row><c r="A1" t="s"><v>0</v></c><c r="AAA1"><v>2.5</v></c></row><row><c r="A900" t="s"><v>1</v></c><c r="AAA900" t="b"><v>1</v></c></row>'),
        "xl/worksheets/sheet2.xml": sheet('<row><c t="inlineStr"><is><t>only</t></is></c></row>'),
    }
    got = P.parse("x.xlsx", package(parts))
    assert [p["text"] for p in got["pages"]] == ["| only |\n| --- |", "| name | 2.5 |\n| --- | --- |\n| ab | TRUE |"]


def test_addresses_by_what_fits_a_whole_table():
    """Headers of six bytes before the address, and one cell whose bytes at eight would fit too."""
    cell = lambda r, c, more: b"\0" * 6 + struct.pack("<HHHH", c, r, *more)
    assert H.addresses([cell(0, 1, (0, 0)), cell(1, 0, (9, 9))], 2, 2) == [(0, 1), (1, 0)]
    assert H.addresses([b"", b"", b""], 2, 2) == [(0, 0), (0, 1), (1, 0)]
    inner = record(H.CTRL_HEADER, 4, H.TABLE_CONTROL.to_bytes(4, "little")) + record(H.LIST_HEADER, 5, b"") + record(H.PARA_TEXT, 6, utf16("x")) + record(H.LIST_HEADER, 5, b"") + record(H.PARA_TEXT, 6, utf16("y"))
    outer = record(H.CTRL_HEADER, 1, H.TABLE_CONTROL.to_bytes(4, "little")) + record(H.TABLE, 2, b"\0" * 4 + struct.pack("<HH", 1, 1)) + record(H.LIST_HEADER, 2, b"")
    # Paragraphs of a cell stand beside its header, as files have them.
    assert list(H.blocks(H.tree(outer + record(66, 2, b"") + record(H.PARA_TEXT, 3, utf16("cell")) + inner).below)) == ["| cell x / y |\n| --- |"]


def test_english_tokens_are_worked_out_once(spark):
    df = spark.range(2).select(F.concat(F.lit("The rail x"), F.col("id").cast("string")).alias("t"))
    assert df.select(T.english_tokens(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3
