"""Inverted lists of vectors: approximate nearest neighbours that read a few lists, and exact ones that
read those which may hold any.

Centroids are fitted once on a bounded sample; every vector then goes to the list of its nearest
centroid, and the table has a folder for each list and part of a list, so that a search reads the
folders of its lists and no other. Parts have about PART_ROWS vectors: a list that holds a large share
of all is read and written by many tasks. The lists' table (a row for each: centroid, number of parts,
widest angle of a member) is small and read whole by every search.

How many lists a search reads is measured when they are built: as many as some of the sample, asked as
questions, need to find RECALL of their nearest. Vectors in clusters need few, those that lie evenly in
all directions most of them.

Vectors are compared by angle. A row without a vector, or with one of zeros, is in no list and never a
neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import search as S

#: Vectors that centroids are fitted on at most, the first by a hash of their ids; and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
PART_ROWS = 50_000
#: Vectors of a list on average at least: a small table has few lists, as each is a file to open. And lists at
#: most: each vector is compared with all centroids, so more of them would cost more for every vector.
LIST_ROWS, MOST_LISTS = 256, 1024
#: Numbers of a matrix that is worked on at a time; and questions that meet a slice of vectors together.
BLOCK, QUESTIONS = 1 << 21, 1024
#: What share of the nearest a search is to find, and how many of the sample are asked to measure it.
RECALL, ASKED = 0.95, 400

_LISTS = "list int, centroid array<double>, parts int, widest double, n long, probes int"


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids at length 1 of unit vectors: k-means by angle, from starts that are far apart by chance."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    chosen = [int(rng.integers(len(sample)))]
    far = 1 - sample @ sample[chosen[0]]
    for _ in range(lists - 1):
        far = np.maximum(far, 0)
        chosen.append(int(rng.choice(len(sample), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(sample))))
        far = np.minimum(far, 1 - sample @ sample[chosen[-1]])
    centers = sample[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        centers[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centers


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int, target: float = RECALL, asked: int = ASKED) -> int:
    """How many lists hold `target` of the k nearest of a vector, over some of the sample that ask for their
    neighbours in it, themselves left out."""
    own = np.argmax(sample @ centers.T, axis=1)
    place = np.argsort(np.argsort(-(sample[:asked] @ centers.T), axis=1, kind="stable"), axis=1)
    found = np.zeros(len(centers) + 1)
    for i in range(min(asked, len(sample))):
        near = sample @ sample[i]
        near[i] = -2
        best = np.argpartition(-near, min(k, len(near) - 1))[:k]
        np.add.at(found, place[i, own[best]], 1)
    share = np.cumsum(found) / max(found.sum(), 1)
    return min(int(np.searchsorted(share, target)) + 1, len(centers))


def _units(vectors: pd.Series) -> np.ndarray:
    return _at_length_one(np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1)))


def _at_length_one(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _assigned(centers: np.ndarray):
    """Rows with an embedding -> the same with list and angle of the nearest centroid, the first of equal ones."""
    step = max(1, BLOCK // max(len(centers), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                near = _at_length_one(_rows(batch.column("embedding"))) @ centers.T
                own = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "list", "angle"])

    return run


def _best_of(query: list[float], k: int):
    """The k best of every batch by similarity as S.similarity gives it."""
    q = np.asarray(query, np.float64)
    length = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, -1)
            size = np.sqrt((x * x).sum(axis=1)) * length
            score = np.round((1 + np.divide(x @ q, size, out=np.zeros(len(x)), where=size > 0)) / 2, 6)
            best = np.lexsort((batch.column("chunk_id").to_numpy(), -score))[:k]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(best)), batch.column("doc_id").take(pa.array(best)), pa.array(score[best])], names=["chunk_id", "doc_id", "score"])

    return run


def _best(pool: DataFrame, query: list[float], k: int, allowed: DataFrame | None) -> DataFrame:
    """S.knn over pool, with scores of a batch worked out at once and its k best handed on."""
    if allowed is not None:
        pool = pool.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    best = pool.select("chunk_id", "doc_id", "embedding").mapInArrow(_best_of(query, k), "chunk_id long, doc_id long, score double")
    return S.top(best, k, "chunk_id")


class VectorTable:
    """The exact search of vectors (chunk_id, doc_id, embedding) by one pass over them. Of vectors that lie
    evenly an exact search reads most lists, so that making them costs more than it saves."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def nearest(self, query: list[float], k: int = S.KNN_CHUNKS, allowed: DataFrame | None = None) -> DataFrame:
        """chunk_id, doc_id, score of the k nearest, found once; a vector of zeros is at a right angle to all others."""
        found = _best(self.vectors.where("embedding IS NOT NULL"), query, k, allowed).collect()
        return self.vectors.sparkSession.createDataFrame(found, "chunk_id long, doc_id long, score double")


class VectorLists:
    """The lists under a path: build writes them, the searches read them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: list | None = None

    # ---- writing ----------------------------------------------------------------------------------

    def build(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> VectorLists:
        """Fit and write vectors (chunk_id, doc_id, embedding), in place of what was there. Without a number
        of lists it is twice the square root of the number of vectors, or fewer where lists would be small."""
        real = vectors.select("chunk_id", "doc_id", "embedding").where(F.exists("embedding", lambda x: x != 0))
        n = real.count()
        lists = lists or max(1, min(round(2 * n**0.5), n // LIST_ROWS, MOST_LISTS))
        drawn = real.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toPandas()["embedding"]
        units = _units(drawn)
        centers = fitted(units, lists) if len(units) else np.zeros((0, 1))
        # Of the k nearest of all, a sample has its share.
        probes = probes_for(units, centers, max(1, round(S.KNN_CHUNKS * len(units) / n))) if len(units) else 0
        # How many parts a list has follows from its share of the sample, so that vectors are assigned and written once.
        share = np.bincount(np.argmax(units @ centers.T, axis=1), minlength=len(centers)) / len(units) if len(units) else np.zeros(0)
        parts = [max(1, -(-round(n * x) // part_rows)) for x in share.tolist()]
        put = real.mapInArrow(_assigned(centers), "chunk_id long, doc_id long, embedding array<float>, list int, angle double") if len(centers) else real.selectExpr("*", "0 AS list", "0D AS angle").limit(0)
        many = F.get(F.array(*[F.lit(m) for m in parts]), F.col("list")) if parts else F.lit(1)
        dealt = put.withColumn("part", F.pmod(F.xxhash64("chunk_id"), many).cast("int"))
        dealt.repartition("list", "part").write.mode("overwrite").partitionBy("list", "part").parquet(f"{self.path}/vectors")
        sizes = self._written().groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
        rows = [(r["list"], [float(x) for x in centers[r["list"]]], parts[r["list"]], r["widest"], r["n"], probes) for r in sizes.orderBy("list").collect()]
        self.spark.createDataFrame(rows, _LISTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists")
        self._known = None
        return self

    # ---- reading ----------------------------------------------------------------------------------

    def lists(self) -> list:
        """Rows of _LISTS, one for each list: as many as there are lists."""
        if self._known is None:
            self._known = self.spark.read.schema(_LISTS).parquet(f"{self.path}/lists").orderBy("list").collect()
        return self._known

    def vectors(self) -> DataFrame:
        return self._written().drop("angle")

    def _written(self) -> DataFrame:
        return self.spark.read.schema("chunk_id long, doc_id long, embedding array<float>, angle double, list int, part int").parquet(f"{self.path}/vectors")

    def _order(self, query: list[float]) -> list[tuple[float, float, int]]:
        """(angle to the centroid, least angle to any member, list) of every list, nearest first."""
        known = self.lists()
        if not known:
            return []
        q = _units(pd.Series([query]))[0]
        angles = np.arccos(np.clip(np.array([r["centroid"] for r in known]) @ q, -1, 1))
        return sorted((float(a), max(0.0, float(a) - r["widest"]), r["list"]) for a, r in zip(angles, known))

    def _among(self, lists: list[int], query: list[float], k: int, allowed: DataFrame | None) -> DataFrame:
        return _best(self.vectors().where(F.col("list").isin(lists)), query, k, allowed)

    def probes(self) -> int:
        """Lists that a search reads unless it says otherwise."""
        return max((r["probes"] for r in self.lists()), default=0)

    def near(self, query: list[float], k: int = S.KNN_CHUNKS, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """chunk_id, doc_id, score of the k nearest of the nearest lists. allowed (doc_id) narrows before
        the cut."""
        return self._among([name for *_, name in self._order(query)[: probes or self.probes()]], query, k, allowed)

    def nearest(self, query: list[float], k: int = S.KNN_CHUNKS, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """near, made exact: when the k-th found is no nearer than a member of another list may be, those
        lists are read too. Angles obey the triangle inequality, so no list that is left out holds any."""
        order = self._order(query)
        first = order[: probes or self.probes()]
        found = self._among([name for *_, name in first], query, k, allowed).select("chunk_id", "doc_id", "score").collect()
        # Scores are rounded to six places: one as good as the k-th may still tie with it.
        worst = float(np.arccos(np.clip(2 * (min(r["score"] for r in found) - 1e-6) - 1, -1, 1))) if len(found) >= k else np.pi
        rest = [name for _, least, name in order[len(first) :] if least <= worst + 1e-9]
        kept = self.spark.createDataFrame(found, "chunk_id long, doc_id long, score double")
        return S.top(kept.union(self._among(rest, query, k, allowed)), k, "chunk_id") if rest else S.top(kept, k, "chunk_id")

    def near_each(self, queries: DataFrame, k: int = S.KNN_CHUNKS, probes: int | None = None) -> DataFrame:
        """query_id, chunk_id, doc_id, score: near for each of queries (query_id, embedding). Small lists lie in
        slices together and parts of large ones in slices of their own, so that a hot list is many tasks."""
        known = self.lists()
        centers, names = np.array([r["centroid"] for r in known]), np.array([r["list"] for r in known])
        many = probes or self.probes()
        dealt, slice_, held = [], 0, 0
        for r in known:
            for part in range(r["parts"]):
                if held and held + r["n"] // r["parts"] > PART_ROWS:
                    slice_, held = slice_ + 1, 0
                dealt.append((r["list"], part, slice_))
                held += r["n"] // r["parts"]

        def read(units: np.ndarray, lists: np.ndarray) -> np.ndarray:
            chosen = np.zeros((len(units), len(names)), bool)
            np.put_along_axis(chosen, np.argsort(-(units @ centers.T), axis=1, kind="stable")[:, :many], True, axis=1)
            return chosen[:, np.searchsorted(names, lists)]

        where = self.spark.createDataFrame(dealt, "list int, part int, slice int")
        return _best_each(self.vectors().join(F.broadcast(where), ["list", "part"]), slice_ + 1, queries, k, read)


def _best_each(vectors: DataFrame, slices: int, queries: DataFrame, k: int, read=None) -> DataFrame:
    """query_id, chunk_id, doc_id, score: the k best vectors for each of queries (query_id, embedding).

    Each slice of vectors (chunk_id, doc_id, embedding, list, slice) meets each block of questions in a task
    that holds the two and hands on the k best of the slice. read tells which questions read which lists.
    """
    asked = queries.select("query_id", F.col("embedding").alias("_q")).where(F.exists("_q", lambda x: x != 0))
    blocks = max(1, -(-asked.count() // QUESTIONS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = vectors.select("chunk_id", "doc_id", "embedding", "list", "slice", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def best(held: pa.Table, questions: pa.Table) -> pa.Table:
        ids, docs, lists = (held.column(c).to_numpy() for c in ("chunk_id", "doc_id", "list"))
        x, q = _at_length_one(_rows(held.column("embedding"))), _at_length_one(_rows(questions.column("_q")))
        names = questions.column("query_id").to_numpy()
        parts = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0)]]
        step = max(1, BLOCK // max(len(x), 1))
        for at in range(0, len(q) if len(x) else 0, step):
            score = np.round((1 + q[at : at + step] @ x.T) / 2, 6)
            if read is not None:
                score[~read(q[at : at + step], lists)] = -1
            least = np.partition(score, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.zeros(len(score))
            for name, own, cut in zip(names[at : at + step], score, least):
                near = np.flatnonzero(own >= max(cut, 0))
                near = near[np.lexsort((ids[near], -own[near]))[:k]]
                parts.append([np.full(len(near), name), ids[near], docs[near], own[near]])
        return pa.table([np.concatenate(c) for c in zip(*parts)], names=["query_id", "chunk_id", "doc_id", "score"])

    found = met.groupBy("slice", "block").cogroup(asked.groupBy("slice", "block")).applyInArrow(best, "query_id long, chunk_id long, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = S.KNN_CHUNKS) -> DataFrame:
    """query_id, chunk_id, doc_id, score: the k nearest of all vectors for each of a set of queries, by brute
    force; what a measure of recall compares with."""
    real = vectors.where(F.exists("embedding", lambda x: x != 0)).select("chunk_id", "doc_id", "embedding", F.lit(0).alias("list"))
    slices = max(1, -(-real.count() // PART_ROWS))
    return _best_each(real.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).cast("int")), slices, queries, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: the share of exact (query_id, chunk_id) that found has too."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 4).alias("recall"))
