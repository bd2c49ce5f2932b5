"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join.

A signature has SYMBOLS minima of independent hashes of a document's shingle set, of which the low
16 bits stay. Two sets of Jaccard similarity s differ in a binomial number of symbols with mean
(1 - s) * SYMBOLS. The join guarantees every pair whose INDEXED symbols differ in at most `radius`,
the mean at the threshold plus SIGMAS standard deviations; a pair within the radius of all symbols
but not of the indexed ones may share no key. For this the indexed symbols are split into so
many chunks that by pigeonhole one of them has at most ERRORS errors, and each chunk is indexed
once for every choice of ERRORS positions that may be wrong. What shares a key is compared by whole
signatures, and what remains is confirmed on full sets, so precision is exact.

No group of copies is expanded: equal sets are one node from the start; a bucket yields a spanning
forest of its close pairs, not the pairs; these forests make clusters, and within a cluster a
prefix-filtered exact join yields a spanning forest of true links. Large buckets and clusters are
dealt over blocks of bounded size, a row to one block, in a few mixes: members of one component meet
in some of them and become one label. Only groups that still have several labels are then compared
in full, in pairs of blocks whose labels differ.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import U64, materialize, mix, shingle_sets, slices, stream, string_buffers
from quarry.llm.components import components

INDEXED = 64
SYMBOLS = 128
ERRORS = 1
SIGMAS = 5.0
#: Members of a bucket, and shingles of a cluster, that one block holds, about.
BUCKET_BLOCK = 4096
CLUSTER_BLOCK = 1 << 19
#: Mixes in which a large group is dealt over blocks before blocks are compared in pairs.
MIXES = 3

_MUL = stream(31, SYMBOLS) | U64(1)
_ADD = stream(37, SYMBOLS)
_KEY = stream(41, INDEXED) | U64(1)


def radius(similarity: float, symbols: int) -> int:
    p = 1 - similarity
    return min(symbols, math.ceil(symbols * p + SIGMAS * math.sqrt(symbols * p * (1 - p))))


def chunk_masks(similarity: float) -> list[tuple[np.ndarray, tuple[int, ...]]]:
    """(symbols of a chunk, those of them that may be wrong) for each key of a signature."""
    n = min(INDEXED, radius(similarity, INDEXED) // (ERRORS + 1) + 1)
    out = []
    for chunk in np.array_split(np.arange(INDEXED), n):
        for wrong in itertools.combinations(chunk.tolist(), min(ERRORS, len(chunk) - 1)):
            out.append((chunk, wrong))
    return out


def signatures(u: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16 array (non-empty sets, SYMBOLS) for concatenated sets."""
    out = np.empty((len(offsets) - 1, SYMBOLS), np.uint16)
    if not len(out):
        return out
    work = np.empty_like(u)
    for k in range(SYMBOLS):
        np.multiply(u, _MUL[k], out=work)
        work += _ADD[k]
        out[:, k] = (mix(np.minimum.reduceat(work, offsets[:-1])) & U64(0xFFFF)).astype(np.uint16)
    return out


def sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_shingles, set fingerprint (two longs), signature."""
    for batch in slices(batches):
        raw, offsets = string_buffers(batch.column("text"))
        u, sets = shingle_sets(raw, offsets, words)
        sizes = np.diff(sets)
        full = sizes > 0
        at = sets[:-1][full]
        fp = np.zeros((2, len(sizes)), np.uint64)
        sig, low = [None] * len(sizes), [None] * len(sizes)
        if len(at):
            fp[0, full] = np.add.reduceat(mix(u ^ U64(0x1234567)), at)
            fp[1, full] = np.add.reduceat(mix(u * U64(0x9E3779B97F4A7C15)), at)
            made = signatures(u, np.append(at, len(u)))
            for i, row in zip(np.flatnonzero(full), made):
                sig[i] = row[:INDEXED].tobytes()
                low[i] = row.astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(low, pa.binary())],
            names=["doc_id", "n_shingles", "fp1", "fp2", "sig", "low"],
        )


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def key_rows(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """rep, sig -> key, rep: a key for each chunk and each choice of its symbols that may be wrong."""
    masks = chunk_masks(similarity)
    salts = stream(43, len(masks))
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            if not batch.num_rows:
                continue
            part = (_matrix(batch.column("sig"), np.uint16).astype(np.uint64) + U64(1)) * _KEY
            keys = np.empty((batch.num_rows, len(masks)), np.uint64)
            for j, (chunk, wrong) in enumerate(masks):
                keys[:, j] = part[:, chunk].sum(axis=1, dtype=np.uint64)
                for w in wrong:
                    keys[:, j] -= part[:, w]
                keys[:, j] ^= salts[j]
            reps = np.repeat(np.asarray(batch.column("rep")), len(masks))
            yield pa.RecordBatch.from_arrays([pa.array(mix(keys).ravel().view(np.int64)), pa.array(reps)], names=["key", "rep"])


def _forest(n: int, near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest; near(i, left) gives those of left that are next to i."""
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                yield from ((i, int(x)) for x in found)
                queue.extend(found.tolist())


def close_pairs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """key, part, rep, low (one byte a symbol), sorted by key and part -> a, b: a spanning forest of each bucket."""
    for keys, columns in _runs(batches, ["key", "part"], ["rep", "low"]):
        reps, low = np.asarray(columns[0]), _matrix(columns[1], np.uint8)
        a, b = [], []
        for s, e in zip(keys[:-1], keys[1:]):
            own = low[s:e]
            if e - s == 2:
                if np.count_nonzero(own[0] != own[1]) <= limit:
                    a.append(reps[s])
                    b.append(reps[s + 1])
                continue
            for i, j in _forest(e - s, lambda i, left: np.count_nonzero(own[left] != own[i], axis=1) <= limit):
                a.append(reps[s + i])
                b.append(reps[s + j])
        if a:
            pairs = np.unique(np.sort(np.array([a, b], np.int64), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(pairs[0])], names=["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], names: list[str]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Batches cut where the key changes: (bounds of the runs, columns); a run is never split."""
    rest: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            rest.append(batch)
            last = [x.column(k)[x.num_rows - 1] for x in rest[-1:] for k in by]
            first = [rest[0].column(k)[0] for k in by]
            if first == last:
                continue
        if not rest:
            return
        table = pa.Table.from_batches(rest).combine_chunks()
        keys = [np.asarray(table.column(k)) for k in by]
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change)])
        if batch is None:
            end, rest = table.num_rows, []
        else:
            end = int(bounds[-1])
            rest = table.slice(end).combine_chunks().to_batches()
        if end:
            cut = np.append(bounds[bounds < end], end)
            yield cut, [table.column(n).slice(0, end).combine_chunks() for n in names]


def links_in(reps: np.ndarray, sets: list[np.ndarray], least: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is at least `least`, exactly.

    Elements are ordered by rarity; a pair over the threshold shares an element among the rarest
    n - ceil(least * n) + 1 of each, so only members of those short lists are compared.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks = order[ids]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ranked = [np.sort(ranks[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
    heads = [r[: len(r) - math.ceil(least * len(r)) + 1] for r in ranked]
    head_rank = np.concatenate(heads)
    head_owner = np.repeat(np.arange(n), [len(x) for x in heads])
    by = np.argsort(head_rank, kind="stable")
    head_rank, head_owner = head_rank[by], head_owner[by]
    all_ranks = np.concatenate(ranked)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    num, den = least.numerator, least.denominator
    mark = np.zeros(len(counts), bool)
    out = []
    for i in range(n):
        lo, hi = np.searchsorted(head_rank, heads[i], "left"), np.searchsorted(head_rank, heads[i], "right")
        wide = np.flatnonzero(hi - lo > 1)
        if not len(wide):
            continue
        others = np.unique(np.concatenate([head_owner[lo[w] : hi[w]] for w in wide]))
        others = others[others > i]
        others = others[(sizes[others] * num <= sizes[i] * den) & (sizes[i] * num <= sizes[others] * den)]
        mine = root(i)
        others = others[[root(int(j)) != mine for j in others]] if len(others) else others
        if not len(others):
            continue
        mark[ranked[i]] = True
        for j in others.tolist():
            both = int(np.count_nonzero(mark[all_ranks[bounds[j] : bounds[j + 1]]]))
            if den * both >= num * (sizes[i] + sizes[j] - both):
                r = root(j)
                if r != root(i):
                    parent[r] = root(i)
                    out.append((i, j))
        mark[ranked[i]] = False
    return [(int(reps[i]), int(reps[j])) for i, j in out]


def confirm(batches: Iterator[pa.RecordBatch], least: Fraction) -> Iterator[pa.RecordBatch]:
    """cluster, part, rep, elements, sorted by cluster and part -> a, b: true links.

    Only the sets of the block at hand are held; batches are cut up as they come.
    """
    now, ids, sets = None, [], []

    def links() -> list[pa.RecordBatch]:
        out = links_in(np.array(ids, np.int64), sets, least) if len(sets) > 1 else []
        if not out:
            return []
        a, b = np.array(out, np.int64).T
        return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])]

    for batch in batches:
        elements = batch.column("elements")
        for i, key in enumerate(zip(batch.column("cluster").to_pylist(), batch.column("part").to_pylist(), batch.column("rep").to_pylist())):
            if key[:2] != now:
                yield from links()
                now, ids, sets = key[:2], [], []
            ids.append(key[2])
            sets.append(np.frombuffer(elements[i].as_buffer(), np.uint64).copy())
    yield from links()


def element_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """rep, cluster, part, text -> the full set as packed 64-bit hashes in place of text."""
    for batch in slices(batches):
        raw, offsets = string_buffers(batch.column("text"))
        u, sets = shingle_sets(raw, offsets, words)
        packed = [u[s:e].tobytes() for s, e in zip(sets[:-1], sets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("cluster"), batch.column("part"), pa.array(packed, pa.binary())],
            names=["rep", "cluster", "part", "elements"],
        )


def _sized(rows: DataFrame, by: str, weight: F.Column, most: int) -> DataFrame:
    """Rows of groups of two or more, with the number of blocks that their group takes. Sizes are
    counted in the map tasks first, and rows meet them by a join that may be split where a key is hot."""
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.sum(weight).alias("_sum"), F.count("*").alias("_rows")).where("_rows > 1")
    sizes = sizes.select("_by", (F.floor((F.col("_sum") - 1) / most) + 1).alias("blocks"))
    return rows.join(sizes, F.col(by) == F.col("_by")).drop("_by")


def _dealt(rows: DataFrame, by: str, mix_no: int) -> DataFrame:
    """Adds part: each row is in one block of its group, by a hash."""
    return rows.withColumn("part", F.pmod(F.xxhash64("rep", by, F.lit(mix_no)), F.col("blocks")))


def _unsettled(rows: DataFrame, by: str, edges: DataFrame) -> DataFrame:
    """Rows of the groups that edges leave in several components, with label."""
    labels = components(edges).select(F.col("node").alias("_node"), F.col("component").alias("_label"))
    marked = materialize(
        rows.drop("label").join(labels, F.col("rep") == F.col("_node"), "left").withColumn("label", F.coalesce("_label", "rep")).drop("_node", "_label"), "labels"
    )
    several = marked.groupBy(F.col(by).alias("_by")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("_by")
    return marked.join(several, F.col(by) == F.col("_by")).drop("_by")


def _crossed(rows: DataFrame, by: str, weight: F.Column, most: int) -> DataFrame:
    """Adds part: rows in blocks by label, each in every pair of blocks that have different labels."""
    run = Window.partitionBy(by).orderBy("label", "rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.withColumn("_blk", F.floor((F.sum(weight).over(run) - 1) / most))
    spans = cut.groupBy(F.col(by).alias("_by"), F.col("_blk").alias("b")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    first = spans.select("_by", F.col("b").alias("i"), "lo")
    pairs = first.join(spans.select("_by", F.col("b").alias("j"), "hi"), "_by").where("i <= j AND lo < hi")
    pairs = pairs.select("_by", F.struct("i", "j").alias("part"), F.explode(F.array_distinct(F.array("i", "j"))).alias("b"))
    part = F.xxhash64("part.i", "part.j").alias("part")
    return cut.join(pairs, (F.col(by) == F.col("_by")) & (F.col("_blk") == F.col("b"))).select(*[F.col(c) for c in rows.columns], part)


def linked(rows: DataFrame, by: str, weight: F.Column, most: int, link) -> DataFrame:
    """Edges that connect within each group of rows (by, rep, ...) what link's pairs connect.

    link takes rows with part and gives the pairs (a, b) found in each (group, part). Groups of one
    block are settled at once.
    """
    rows = materialize(_sized(rows, by, weight, most), "groups")
    edges = materialize(link(_dealt(rows, by, 0)), "links")
    left = rows.where("blocks > 1")
    for mix_no in range(1, MIXES + 1):
        if not left.limit(1).count():
            return edges
        left = _unsettled(left, by, edges)
        more = link(_dealt(left, by, mix_no) if mix_no < MIXES else _crossed(left, by, weight, most))
        edges = materialize(edges.union(more), "links")
    return edges


def near_duplicates(docs: DataFrame, similarity: Fraction = Fraction(4, 5), words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of word shingles is at least
    `similarity`; component_id is the smallest id reachable over links. Empty and null texts have
    an empty set and no links. A row without an id takes no part: component_id null, kept false.
    Rows that repeat an id and text get the same answer each; rows that repeat an id with another
    text are one document with the links of all of them, where no smaller id has the same set.
    Other columns are not looked at, so their names can't clash. An empty table gives an empty result.
    """
    similarity = Fraction(similarity)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(
        source.mapInArrow(
            lambda it: sketch(it, words),
            "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary, low binary",
        ),
        "sketch",
    )
    filled = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = materialize(
        filled.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("low").alias("low")), "sets"
    )
    masks_at = float(similarity)
    limit = radius(masks_at, SYMBOLS)
    keys = reps.select("rep", "sig").mapInArrow(lambda it: key_rows(it, masks_at), "key long, rep long")

    def close(rows: DataFrame) -> DataFrame:
        signed = rows.select("key", "part", "rep").join(reps.select("rep", "low"), "rep").select("key", "part", "rep", "low")
        return signed.repartition("key", "part").sortWithinPartitions("key", "part", "rep").mapInArrow(lambda it: close_pairs(it, limit), "a long, b long")

    def true_links(rows: DataFrame) -> DataFrame:
        # Blocks are dealt out before texts join them, so that no window ever holds a text or a set.
        return (
            source.join(rows.select("rep", "cluster", "part"), F.col("doc_id") == F.col("rep"))
            .select("rep", "cluster", "part", "text")
            .mapInArrow(lambda it: element_rows(it, words), "rep long, cluster long, part long, elements binary")
            .where("length(elements) > 0")
            .repartition("cluster", "part")
            .sortWithinPartitions("cluster", "part", "rep")
            .select("cluster", "part", "rep", "elements")
            .mapInArrow(lambda it: confirm(it, similarity), "a long, b long")
        )

    near = components(linked(keys, "key", F.lit(1), BUCKET_BLOCK, close)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    sized = near.join(filled.groupBy(F.col("doc_id").alias("rep")).agg(F.max("n_shingles").alias("n")), "rep")
    found = components(linked(sized, "cluster", F.col("n"), CLUSTER_BLOCK, true_links))
    by_set = reps.join(found, reps.rep == found.node, "left").select(
        "fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    answer = sets.join(by_set, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return answer.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def keep_one_per_group(docs: DataFrame, similarity: Fraction = Fraction(4, 5), words: int = 5) -> DataFrame:
    """The documents that stay, with the columns of docs, whatever their names; rows without an id stay."""
    gone = near_duplicates(docs, similarity, words).where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = F.col(f"c{docs.columns.index('doc_id')}")
    return inner.join(materialize(gone, "gone"), own == F.col("gone"), "left_anti").toDF(*docs.columns)
