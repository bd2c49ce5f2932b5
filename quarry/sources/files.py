"""Sources and sinks: uploads, parsed results, the index, backups and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import extension
from quarry.operators.lifecycle import BACKUPS_KEPT, keep_newest
from quarry.sources.parse import ACCEPTED, RESULT

MAX_BYTES = 500 << 20
MAX_OTHER_BYTES = 100 << 20
MAX_PAGES = 3000


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole UTF-8 files; bytes that are no text are left out."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches):
        for b in batches:
            yield b.assign(text=[bytes(c).decode("utf-8", "ignore") for c in b["content"]])[["path", "text"]]

    return raw.mapInPandas(decode, "path string, text string")


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed results written as JSON, one file or line each; pages may name their number page or page_num."""
    schema = RESULT.replace("struct<page: int,", "struct<page: int, page_num: int,") + ", doc_id long"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    page = lambda p: F.struct(F.coalesce(p["page_num"], p["page"]).alias("page"), p["text"].alias("text"), p["method"].alias("method"), p["ocr_confidence"].alias("ocr_confidence"), F.coalesce(p["flagged"], F.lit(False)).alias("flagged"))
    return raw.withColumn("pages", F.transform(F.coalesce("pages", F.array().cast("array<struct<page:int,page_num:int,text:string,method:string,ocr_confidence:double,flagged:boolean>>")), page))


def upload_errors(files: DataFrame) -> DataFrame:
    """Adds error: why an upload (name, length, page_count) is not taken, null where it is."""
    kind = F.substring(extension(F.col("name")), 2, 20)
    mb = lambda limit: F.concat(F.round(F.col("length") / (1 << 20), 1).cast("string"), F.lit(f" MB is over {limit >> 20} MB"))
    why = (
        F.when(F.coalesce("name", F.lit("")) == "", "no name")
        .when(~kind.isin(*ACCEPTED), "format not accepted")
        .when(F.col("length") > MAX_BYTES, mb(MAX_BYTES))
        .when((kind != "pdf") & (F.col("length") > MAX_OTHER_BYTES), mb(MAX_OTHER_BYTES))
        .when(F.col("page_count") > MAX_PAGES, "too many pages")
    )
    return files.withColumn("error", why)


def safe_path(path: Column) -> Column:
    """path without empty, current and parent parts, so that it stays below its folder."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..") & ~p.rlike("^[A-Za-z]:$")), "/")


def free_names(files: DataFrame, order: list[Column]) -> DataFrame:
    """Adds saved_path: the safe path, with (2), (3) and so on before the extension where taken."""
    out = files.withColumn("_p", safe_path(F.col("path")))
    n = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    stem, ext = F.regexp_replace("_p", r"\.[^./]*$", ""), F.regexp_extract("_p", r"(\.[^./]*)$", 1)
    return out.withColumn("_n", n).withColumn("saved_path", F.when(F.col("_n") == 1, F.col("_p")).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext))).drop("_p", "_n")


def list_backups(spark: SparkSession, path: str) -> DataFrame:
    """name, size, modified of the files of a backup folder, newest first; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), F.desc("name"))


def fetch_backup(spark: SparkSession, path: str, name: str) -> DataFrame:
    """name, content of a backup file; no row unless the folder has a file of just that name."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.substring_index("path", "/", -1) == name).select(F.lit(name).alias("name"), "content")


def delete_backup(spark: SparkSession, path: str, name: str) -> bool:
    """Delete a backup file of a folder; False where the folder has none of just that name."""
    if name not in {r.name for r in list_backups(spark, path).where(F.col("name") == name).select("name").collect()}:
        return False
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    return bool(file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False))


def write_backup(tables: dict[str, DataFrame], path: str, stamp: str) -> None:
    """A snapshot of each table under its own folder and stamp; what a failed run left there is written over."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/backup_ts={stamp}")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """prefix, name of the finished snapshots under a backup folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/*/backup_ts=*/_SUCCESS")
    done = [s.getPath().getParent() for s in found.getFileSystem(conf).globStatus(found) or []]
    return spark.createDataFrame([(p.getParent().getName(), p.getName()) for p in done], "prefix string, name string")


def backup(spark: SparkSession, tables: dict[str, DataFrame], path: str, stamp: str, keep: int = BACKUPS_KEPT) -> list[str]:
    """The backup job: a snapshot of each table, then of every table's snapshots the `keep` newest stay.
    Returns what went, as table/backup_ts=stamp. Run again with its stamp it changes nothing."""
    write_backup(tables, path, stamp)
    old = keep_newest(snapshots(spark, path), "prefix", [F.desc("name")], keep).where("NOT keep")
    gone = sorted(f"{r['prefix']}/{r['name']}" for r in old.collect())  # a name for each run since the last job
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


#: The export's columns, and its names of categories and states.
EXPORT = ("ID", "파일명", "파일형식", "원본경로", "카테고리", "상태", "페이지수", "OCR저신뢰", "업로드시각")
CATEGORY_NAMES = {"spec": "사양서", "research": "연구자료", "presentation": "발표자료", "report": "보고서"}
NO_CATEGORY, DONE, NOT_DONE, TO_CHECK, FINE = "미지정", "성공", "실패", "검토필요", "정상"


def export_rows(docs: DataFrame) -> DataFrame:
    """The nine columns of the document list as text, with labels."""
    named = F.col("category")
    for key, name in CATEGORY_NAMES.items():
        named = F.when(F.col("category") == key, name).otherwise(named)
    values = (
        F.col("id").cast("string"),
        F.col("filename"),
        F.coalesce("file_type", F.lit("")),
        F.coalesce("original_path", F.lit("")),
        F.coalesce(F.nullif(named, F.lit("")), F.lit(NO_CATEGORY)),
        F.when(F.col("status") == "success", DONE).otherwise(NOT_DONE),
        F.coalesce(F.col("page_count").cast("string"), F.lit("")),
        F.when(F.col("has_flagged"), TO_CHECK).otherwise(FINE),
        F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss"),
    )
    return docs.select(*[v.alias(n) for v, n in zip(values, EXPORT)])


def write_csv(docs: DataFrame, path: str) -> None:
    """Comma-separated files with a header and a byte order mark before it."""
    rows = export_rows(docs)
    marked = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0])
    marked.write.option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)


def jdbc_url(url: str) -> str:
    """The JDBC form of a database's address, whatever driver of another language it names."""
    for old, new in (("postgresql+asyncpg:", "postgresql:"), ("postgres:", "postgresql:"), ("sqlite+aiosqlite:", "sqlite:")):
        url = new + url.removeprefix(old) if url.startswith(old) else url
    return url if url.startswith("jdbc:") else "jdbc:" + url


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A relational table, whose filters and columns the database evaluates; with a numeric key, read in
    parts between bounds, or else between the key's least and greatest value."""
    reader = spark.read.format("jdbc").option("url", jdbc_url(url)).option("dbtable", name)
    if key and bounds is None:
        low, high = reader.load().agg(F.min(key), F.max(key)).first()
        bounds = None if low is None else (low, high)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def upsert_jdbc(rows: DataFrame, url: str, name: str, key: list[str], types: str | None = None, parts: int = 8) -> None:
    """Rows into a relational table, in place of those with their keys; created where there is none. Tasks
    write a stage table, in any order and as often as they are run; one transaction moves it, so that a
    job that fails or is run again leaves each key once. Of rows with one key one is taken; null keys
    are left out. types says what columns are to be in a new table, for databases whose default for
    texts can't be compared."""
    spark, address = rows.sparkSession, jdbc_url(url)
    stage = f"{name}_stage"
    fit = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).dropDuplicates(key)
    writer = fit.coalesce(parts).write.format("jdbc").option("url", address).option("dbtable", stage).mode("overwrite")
    (writer.option("createTableColumnTypes", types) if types else writer).save()
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    same = " AND ".join(f's."{k}" = t."{k}"' for k in key)
    connection = spark._jvm.java.sql.DriverManager.getConnection(address)
    try:
        there = connection.getMetaData().getTables(None, None, name.upper(), None).next()
        connection.setAutoCommit(False)
        sql = connection.createStatement()
        if there:
            sql.executeUpdate(f"DELETE FROM {name} t WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same})")
        else:
            sql.executeUpdate(f"CREATE TABLE {name} AS SELECT {columns} FROM {stage} WITH NO DATA")
        sql.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage}")
        sql.executeUpdate(f"DROP TABLE {stage}")
        connection.commit()
    finally:
        connection.close()
