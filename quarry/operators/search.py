"""Retrieval: postings, BM25, vector search and rank fusion.

Statistics always come from the whole index; a set of allowed documents narrows what is ranked,
never what is counted. Scores are rounded to six places before they are ranked, so that the order
of summation can't change a rank, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import terms

#: Fields of the index and their weight.
FIELDS = {"text": 2.0, "title": 1.0, "filename": 1.0, "memo": 1.0}
LUCENE = (1.2, 0.75)
OKAPI = (1.5, 0.75, 0.25)
MIN_MATCH = 0.75
SEM_MINIMUM, SEM_STRONG = 0.74, 0.78
RRF_SEM, RRF_BM25 = 30, 60
OLD_RRF_BM25, OLD_RRF_VEC = 30, 60
BM25_DOCS, KNN_CHUNKS, RESULTS = 100, 50, 50
COUNTED = "chunk_id long, doc_id long, field string, dl long, runs array<struct<term: string, tf: long>>"
#: Tokens that are counted at a time.
TOKENS = 1 << 19

# Technical terms that queries in one language gain in the other.
EN_TO_KO = {
    "oscilloscope": "오실로스코프",
    "timing margin": "타이밍 마진",
    "margin": "마진",
    "measurement": "측정",
    "erase": "소거",
    "bad block": "배드 블록",
    "endurance": "내구성",
    "temperature": "온도",
    "high temperature": "고온",
    "low temperature": "저온",
    "synthesis": "합성",
    "utilization": "사용률",
    "simulation": "시뮬레이션",
}
KO_TO_EN = {
    "타이밍 제약": "timing constraint set_false_path set_multicycle",
    "클럭 경로": "clock path set_false_path",
    "예외 처리": "exception set_false_path multicycle set_multicycle_path",
    "산포 수집": "scatter gather",
    "전송 엔진": "DMA",
    "레지스터 맵": "NFC_CTRL NFC_STATUS register map offset",
    "음수 슬랙": "negative slack",
    "체크포인트": "checkpoint",
}
#: Fixed value: question words that a query leaves out.
QUESTION_WORDS = ("얼마", "언제", "어디", "누구", "무엇", "뭐", "몇", "어느", "무슨", "어떤")


class IndexUnavailable(ValueError):
    """There is no index to search: not the same as a search without results."""


def _tokens(field: str, tokenize) -> Column:
    return F.array_remove(tokenize(F.coalesce(F.col(field), F.lit(""))), "")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with tokens ts -> the same with dl and runs, of as many rows at a time as have TOKENS of them."""
    for whole in batches:
        ends = np.asarray(whole.column("ts").offsets)
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1)
            batch, at = whole.slice(at, to - at), to
            ts = batch.column("ts")
            dl = np.diff(np.asarray(ts.offsets)).astype(np.int64)
            coded = ts.flatten().dictionary_encode()
            size = max(len(coded.dictionary), 1)
            found, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * size + coded.indices.to_numpy(), return_counts=True)
            runs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(found % size)), pa.array(tf.astype(np.int64))], names=["term", "tf"])
            starts = np.concatenate([[0], np.cumsum(np.bincount(found // size, minlength=len(dl)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk_id", "doc_id", "field")), pa.array(dl), pa.ListArray.from_arrays(pa.array(starts), runs)], names=["chunk_id", "doc_id", "field", "dl", "runs"])


def term_counts(chunks: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), tokenize=terms) -> DataFrame:
    """chunk_id, doc_id, field, dl, runs: a row for each field with terms of each chunk, and how often each term
    stands in it. One pass over the chunks and no shuffle. Chunks differ in chunk_id."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _tokens(f, tokenize).alias("ts")) for f in fields])).alias("f")
    split = chunks.select("chunk_id", "doc_id", each).select("chunk_id", "doc_id", "f.field", "f.ts").where(F.size("ts") > 0)
    return split.mapInArrow(_counted, COUNTED)


def posted(counts: DataFrame) -> DataFrame:
    """chunk_id, doc_id, field, term, tf, dl of term_counts: one row for each term of each field of each chunk."""
    return counts.select("chunk_id", "doc_id", "field", "dl", F.explode("runs").alias("r")).select("chunk_id", "doc_id", "field", "dl", "r.term", "r.tf")


def postings(chunks: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), tokenize=terms) -> DataFrame:
    """posted term_counts of chunks. To be written sorted by term and read by many queries (see sources.index)."""
    return posted(term_counts(chunks, fields, tokenize))


def field_stats(index: DataFrame) -> DataFrame:
    """field, n (chunks with terms), avgdl."""
    sizes = index.groupBy("field", "chunk_id").agg(F.max("dl").alias("dl"))
    return sizes.groupBy("field").agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def field_sizes(chunks: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), tokenize=terms) -> DataFrame:
    """field, dl: the number of terms of each field of each chunk that has any."""
    size = lambda f: F.size(_tokens(f, tokenize)).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), size(f).alias("dl")) for f in fields])).alias("f")
    return chunks.select(each).select("f.field", "f.dl").where("dl > 0")


def chunk_stats(chunks: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), tokenize=terms) -> DataFrame:
    """field_stats of the postings of chunks, counted without a row for each term."""
    return field_sizes(chunks, fields, tokenize).groupBy("field").agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def query_terms(query: str) -> list[str]:
    import re

    found = re.split(r"[^\w]+", query.lower())
    return list(dict.fromkeys(t for t in found if t and t not in QUESTION_WORDS))


def bm25(index: DataFrame, stats: DataFrame, query: list[str], boosts: dict[str, float] = FIELDS, min_match: float = MIN_MATCH, allowed: DataFrame | None = None) -> DataFrame:
    """chunk_id, doc_id, score: the best field of each chunk that holds enough of the query's terms.

    The postings are cut to the query's terms first; what is joined to them has a row for each
    field or for each term and field.
    """
    k1, b = LUCENE
    hits = index.where(F.col("term").isin(query))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    need = max(1, int(min_match * len(query)))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    boost = F.lit(0.0)
    for field, value in boosts.items():
        boost = F.when(F.col("field") == field, F.lit(value)).otherwise(boost)
    scored = (
        hits.join(F.broadcast(df), ["field", "term"])
        .join(F.broadcast(stats), "field")
        .groupBy("chunk_id", "doc_id", "field")
        .agg((F.sum(idf * weight)).alias("s"), F.count("*").alias("matched"))
        .where(F.col("matched") >= need)
        .groupBy("chunk_id", "doc_id")
        .agg(F.round(F.max(F.col("s") * boost), 6).alias("score"))
        .where("score > 0")
    )
    return scored if allowed is None else scored.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")


def bm25_each(index: DataFrame, stats: DataFrame, words: DataFrame, boosts: dict[str, float] = FIELDS, min_match: float = MIN_MATCH) -> DataFrame:
    """query_id, chunk_id, doc_id, score: what bm25 gives for each query of words (query_id, term).

    A chunk with enough of a query's terms has one of its rarest, so only chunks of those are looked
    up for the others; nothing is joined without a key and nothing is broadcast by force.
    """
    k1, b = LUCENE
    words = words.select("query_id", "term").distinct()
    need = words.groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(F.lit(min_match) * F.count("*"))).alias("need"))
    hits = index.join(words.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    group = Window.partitionBy("query_id", "field")
    order = F.row_number().over(group.orderBy("df", "term"))
    asked = words.join(df, "term").join(need, "query_id").withColumn("first", order <= F.count("*").over(group) - F.col("need") + 1)
    found = hits.join(asked.where("first").select("query_id", "field", "term", "need"), ["field", "term"]).select("query_id", "field", "chunk_id", "need").distinct()
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    boost = F.lit(0.0)
    for field, value in boosts.items():
        boost = F.when(F.col("field") == field, F.lit(value)).otherwise(boost)
    return (
        found.join(asked.select("query_id", "field", "term", "df"), ["query_id", "field"])
        .join(hits, ["chunk_id", "field", "term"])
        .join(stats, "field")
        .groupBy("query_id", "chunk_id", "doc_id", "field", "need")
        .agg(F.sum(idf * weight).alias("s"), F.count("*").alias("matched"))
        .where(F.col("matched") >= F.col("need"))
        .groupBy("query_id", "chunk_id", "doc_id")
        .agg(F.round(F.max(F.col("s") * boost), 6).alias("score"))
        .where("score > 0")
    )


def holders(passages: DataFrame, docs: DataFrame, tokenize=terms) -> DataFrame:
    """query_id, doc_id: the docs (doc_id, text) that contain a passage (query_id, passage) as a whole.

    Inner terms of a passage are terms of each text that contains it; the longest, as the likeliest
    to be rare, is the key by which they meet. Passages without an inner term are looked up in every text, blank ones nowhere.
    """
    asked = passages.where(F.trim("passage") != "")
    whole = tokenize(F.col("passage"))
    inner = asked.withColumn("ts", F.array_distinct(F.filter(F.slice(whole, 2, F.greatest(F.size(whole) - 2, F.lit(0))), lambda t: t != "")))
    long = F.array_max(F.transform("ts", lambda t: F.struct(F.length(t).alias("n"), t.alias("term"))))
    key = inner.where(F.size("ts") > 0).select("query_id", long["term"].alias("term"))
    held = docs.select("doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    met = key.join(held, "term").select("query_id", "doc_id").join(asked, "query_id").join(docs.select("doc_id", "text"), "doc_id")
    bare = inner.where(F.size("ts") == 0).select("query_id", "passage").crossJoin(docs.select("doc_id", "text"))
    return met.where(F.contains("text", "passage")).select("query_id", "doc_id").union(bare.where(F.contains("text", "passage")).select("query_id", "doc_id"))


def okapi_stats(index: DataFrame, n_chunks: int | None = None) -> DataFrame:
    """One row n, avgdl, mean: chunks, their mean length and the mean of all terms' idf. n_chunks counts
    chunks without terms too, which the index does not have."""
    sizes = index.groupBy("chunk_id").agg(F.max("dl").alias("dl"))
    n = F.lit(n_chunks) if n_chunks is not None else F.count("*")
    whole = sizes.agg(n.cast("long").alias("n"), (F.sum("dl") / n).alias("avgdl"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(whole)).select("n", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    return raw.groupBy("n", "avgdl").agg((F.sum("raw") / F.count("*")).alias("mean"))


def okapi(index: DataFrame, query: list[str], stats: DataFrame | None = None) -> DataFrame:
    """chunk_id, doc_id, score of the older index: no field weights, negative idf lifted to a share
    of the mean idf, a token of the query counted as often as it stands there, and only positive
    scores kept. stats is okapi_stats, kept with the index."""
    k1, b, eps = OKAPI
    stats = okapi_stats(index) if stats is None else stats
    asked = F.lit(0)
    for term in dict.fromkeys(query):
        asked = F.when(F.col("term") == term, F.lit(query.count(term))).otherwise(asked)
    hits = index.where(F.col("term").isin(query))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = hits.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
    idf = idf.select("term", "avgdl", F.when(raw < 0, eps * F.col("mean")).otherwise(raw).alias("idf"), asked.alias("times"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(idf), "term")  # a row for each term of the query
    return scored.groupBy("chunk_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def best_per_doc(hits: DataFrame) -> DataFrame:
    """The best chunk of each document; of equal ones the first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top(hits: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return hits.orderBy(F.desc("score"), key).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v at length 1."""
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def similarity(vector: Column, query: list[float]) -> Column:
    """(1 + cosine) / 2, rounded for ranking; a vector of zeros is at a right angle to all others."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    return F.round((1 + F.coalesce(F.try_divide(dot(vector, q), F.sqrt(dot(vector, vector)) * F.lit(norm)), F.lit(0.0))) / 2, 6)


def knn(vectors: DataFrame, query: list[float], k: int = KNN_CHUNKS, allowed: DataFrame | None = None) -> DataFrame:
    """chunk_id, doc_id, score of the k nearest chunks, exactly; allowed narrows before the cut."""
    pool = vectors if allowed is None else vectors.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    return top(pool.select("chunk_id", "doc_id", similarity(F.col("embedding"), query).alias("score")), k, "chunk_id")


#: Steps of a coded number: four bits.
STEPS = 15


def coded(vectors: DataFrame) -> DataFrame:
    """chunk_id, doc_id, low, step, codes: vectors as four-bit numbers between their least and greatest."""
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    sized = vectors.select("chunk_id", "doc_id", "embedding", low.alias("low"), ((high - low) / STEPS).alias("step"))
    code = lambda x: F.when(F.col("step") > 0, F.floor((x.cast("double") - F.col("low")) / F.col("step") + 0.5)).otherwise(0).cast("tinyint")
    return sized.select("chunk_id", "doc_id", "low", "step", F.transform("embedding", code).alias("codes"))


def knn_coded(codes: DataFrame, query: list[float], k: int = KNN_CHUNKS) -> DataFrame:
    """chunk_id, doc_id, score of the k chunks whose coded vectors are nearest: an eighth of the bytes of
    exact ones are read. min(k, n) rows."""
    near = similarity(F.transform("codes", lambda c: F.col("low") + c * F.col("step")), query)
    return top(codes.select("chunk_id", "doc_id", near.alias("score")), k, "chunk_id")


def ranked(hits: DataFrame, name: str) -> DataFrame:
    """doc_id, score and rank of at most a few hundred best documents."""
    w = Window.partitionBy().orderBy(F.desc("score"), "doc_id")
    return hits.select("doc_id", F.col("score").alias(f"{name}_score"), F.col("chunk_id").alias(f"{name}_chunk"), F.row_number().over(w).cast("long").alias(f"{name}_rank"))


def hybrid(bm25_hits: DataFrame, knn_hits: DataFrame, minimum: float = SEM_MINIMUM, strong: float = SEM_STRONG, k_sem: int = RRF_SEM, k_bm25: int = RRF_BM25) -> DataFrame:
    """doc_id, score, bm25_rank, sem_rank, chunk_id: gated reciprocal rank fusion.

    bm25_hits: the best chunk of at most BM25_DOCS documents; knn_hits: at most KNN_CHUNKS chunks.
    With keyword hits, their documents and those of a strong similarity are candidates, without
    them those of the minimum. Ranks are over all hits, not over candidates; a missing rank is one
    more than the number of candidates. Both inputs have bounded size, so the windows without
    partitions hold a few hundred rows.
    """
    b = ranked(bm25_hits, "bm25")
    s = ranked(best_per_doc(knn_hits), "sem")
    everything = Window.partitionBy()
    merged = b.join(s, "doc_id", "full_outer").withColumn("kw", F.count("bm25_rank").over(everything) > 0)
    gate = F.when(F.col("kw"), F.lit(strong)).otherwise(F.lit(minimum))
    kept = merged.where(F.col("bm25_rank").isNotNull() | (F.col("sem_score") >= gate)).withColumn("n", F.count("*").over(everything))
    absent = F.col("n") + 1
    score = 1 / (k_sem + F.coalesce("sem_rank", absent)) + 1 / (k_bm25 + F.coalesce("bm25_rank", absent))
    return kept.select("doc_id", score.alias("raw"), "bm25_rank", "sem_rank", F.coalesce("sem_chunk", "bm25_chunk").alias("chunk_id"))


def final_page(fused: DataFrame, limit: int = RESULTS) -> DataFrame:
    """The best documents with their places: scores relative to the best and rounded to four places.
    Equal ones stand as candidates did, keyword hits by rank and then the others by similarity."""
    order = [F.desc("raw"), F.asc_nulls_last("bm25_rank"), F.col("sem_rank")]
    best = fused.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.partitionBy().orderBy(*order)).alias("place")
    return best.select("doc_id", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy()), 4).alias("score"), "bm25_rank", "sem_rank", "chunk_id", place)


def hybrid_old(bm25_hits: DataFrame, vec_hits: DataFrame, top_k: int = 10) -> DataFrame:
    """The older fusion by chunk: a list in which a chunk is missing adds nothing."""

    def rank(hits: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy().orderBy(F.desc("score"), "chunk_id")
        return hits.select("chunk_id", F.row_number().over(w).cast("long").alias(name))

    merged = rank(bm25_hits, "bm25_rank").join(rank(vec_hits, "vec_rank"), "chunk_id", "full_outer")
    part = lambda k, r: F.coalesce(1 / (k + F.col(r)), F.lit(0.0))
    return merged.withColumn("score", F.round(part(OLD_RRF_BM25, "bm25_rank") + part(OLD_RRF_VEC, "vec_rank"), 9)).orderBy(F.desc("score"), "chunk_id").limit(top_k)


def fetch_k(top_k: int, total: int) -> int:
    """How many hits of each kind the older fusion reads."""
    return min(max(3 * top_k, 30), total) if total > 0 else top_k


def augmented(query: Column) -> Column:
    """query with the terms that the other language has for what it names, longest first, once each."""
    hangul = query.rlike("[가-힣]")

    def gained(names: dict[str, str], low: Column) -> Column:
        ordered = sorted(names, key=len, reverse=True)
        found = F.array_distinct(F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(names[k])) for k in ordered]), lambda x: x.isNotNull()))
        return F.when(F.size(found) > 0, F.concat_ws(" ", query, F.array_join(found, " "))).otherwise(query)

    return F.when(hangul, gained(KO_TO_EN, query)).otherwise(gained(EN_TO_KO, F.lower(query)))


def first_ranks(results: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, rank: where the first file that a query asks for stands among its different files.

    results: query_id, place, name; targets: query_id, name.
    """
    first = results.groupBy("query_id", "name").agg(F.min("place").alias("place"))
    w = Window.partitionBy("query_id").orderBy("place")
    ranks = first.withColumn("rank", F.row_number().over(w).cast("long"))
    hit = ranks.join(targets.select("query_id", "name").distinct(), ["query_id", "name"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return targets.select("query_id").distinct().join(hit, "query_id", "left")


def retrieval_metrics(ranks: DataFrame, kinds: list[str]) -> DataFrame:
    """n, hit1, hit5, mrr10 over all and over each value of the given columns (rank, ...)."""
    within = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    mrr = F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0))
    sets = [[], *[[k] for k in kinds]]
    out = ranks.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in kinds])
    return out.agg(F.count("*").alias("n"), F.round(within(1), 3).alias("hit1"), F.round(within(5), 3).alias("hit5"), F.round(mrr, 3).alias("mrr10"))
