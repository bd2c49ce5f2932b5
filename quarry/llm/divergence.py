"""Divergence of sources: how far the terms of a source are from those of each other source of its
language, and which terms stand out in it.

A group is a (lang, source) that occurs; null values and a null text count as ''. A term is a run of
letters and code points above 0x7F with A-Z lower-cased; a language keeps the terms of at least
MIN_DOCS of its documents, V in all. A group or a language that has N occurrences of kept terms gives
a term with n of them the share p = 1 + floor(SCALE * (n + 1) / (N + V)), and p differs from q by
floor((p - q)^2 / q). All numbers are integers and exact up to N + V = 9 * 10^15 and V = 10^9; beyond,
the division fails instead of rounding.

The sum over all kept terms of a language is taken without all terms of all pairs. Terms that neither
group has cost the same each: V times that is the base, to which come corrections.

* Heavy terms, those of many groups: dense numpy tiles of about BLOCK groups against BLOCK groups and a
  share of the terms, each giving partial sums over the terms that it holds.
* Light terms: what a term that one group has and the other lacks differs by depends on its count
  alone, so a histogram of the counts of a group's light terms is enough, evaluated in the same tiles;
  for the few pairs of groups that share the light term, its posting list gives what that misses.

The partial sums are integers and add up in any order. Every piece of work has a bounded size: a tile
by its blocks, a posting list by LIGHT_GROUPS. The result has a row for each pair of sources of a
language; nothing of that size is built before.

Odd rows: repeated rows count each; a table without rows has no groups; doc_id and other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, slices, string_buffers

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Groups of a block, and entries of a block that a tile holds on average.
BLOCK, TILE_ROWS = 32, 4_096
#: A term is light in at most this share of its language's groups, and in no more groups than that.
LIGHT_SHARE, LIGHT_LEAST, LIGHT_GROUPS = 5, 2, 64
#: Distinct terms that a task counts before it sends them on.
HELD_TERMS = 300_000

_COUNTS = "lang string, source string, term string, n long, df long"
_TILE = "lang string, source string, item string, value long"
_HEADER, _ENTRY, _HISTOGRAM = 0, 1, 2

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, and a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = [None, *n]
            for at in range(0, len(terms), 1 << 16):
                part = terms[at : at + (1 << 16)]
                columns = [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array([source] * len(part), pa.string()),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([n[t] for t in part], pa.int64()),
                    pa.array([df[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])
        held.clear()

    for batch in slices(batches):
        raw, offsets = string_buffers(batch.column("text"))
        data = raw.tobytes().translate(_TERM_BYTES)
        for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
            n, df = held.setdefault(group, (Counter(), Counter()))
            terms = data[offsets[i] : offsets[i + 1]].split()
            n.update(terms)
            df.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df of docs (lang, source, text), and a row with a null term for each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)) in 64 bits, three digits at a time."""

    def step(acc: Column) -> Column:
        r = acc["r"] * 1000
        return F.struct((acc["q"] * 1000 + F.call_function("div", r, total + kept)).alias("q"), (r % (total + kept)).alias("r"))

    whole = F.struct(F.call_function("div", n + 1, total + kept).alias("q"), ((n + 1) % (total + kept)).alias("r"))
    return step(step(step(whole)))["q"] + 1


def shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """share for numpy arrays."""
    q, r = np.divmod(n + 1, total + kept)
    for _ in range(3):
        more, r = np.divmod(r * 1000, total + kept)
        q = q * 1000 + more
    return q + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _tile_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q)^2 / q) for every row of p and every row of q."""
    out = np.empty((len(p), len(q)), np.int64)
    for i, row in enumerate(p):
        out[i] = ((row - q) ** 2 // q).sum(axis=1)
    return out


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Partial sums of a tile for each ordered pair of groups of its two blocks."""
    lang, low, high, tile = (k.as_py() for k in key)
    part, block = table.column("part").to_numpy(), table.column("block").to_numpy()
    n, times, total = (table.column(c).to_numpy() for c in ("n", "times", "total"))
    kept = int(table.column("kept")[0].as_py())
    source = table.column("source").combine_chunks().dictionary_encode()
    code, names = source.indices.to_numpy(), np.array(source.dictionary.to_pylist(), object)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    entries = part == _ENTRY
    term = table.column("term").filter(pa.array(entries)).combine_chunks().dictionary_encode()
    columns, width = term.indices.to_numpy(), len(term.dictionary)

    def side(which: int) -> dict:
        heads = np.flatnonzero((part == _HEADER) & (block == which))
        at = np.full(len(names), -1)
        at[code[heads]] = np.arange(len(heads))
        zero = shares(np.zeros(len(heads), np.int64), total[heads], kept) if kept else np.ones(len(heads), np.int64)
        dense = np.repeat(zero[:, None], width, axis=1)
        mine = block[entries] == which
        rows = np.flatnonzero(entries)[mine]
        dense[at[code[rows]], columns[mine]] = shares(n[rows], total[rows], kept) if kept else 1
        rare = np.flatnonzero((part == _HISTOGRAM) & (block == which))
        return {"names": names[code[heads]], "zero": zero, "dense": dense, "rare": (at[code[rare]], shares(n[rare], total[rare], kept) if kept else n[rare], times[rare])}

    def pairs(a: dict, b: dict) -> np.ndarray:
        base = (a["zero"][:, None] - b["zero"]) ** 2 // b["zero"]
        out = _tile_sums(a["dense"], b["dense"]) - width * base
        for row, p, m in zip(*a["rare"]):
            out[row] += m * ((p - b["zero"]) ** 2 // b["zero"] - base[row])
        for row, q, m in zip(*b["rare"]):
            out[:, row] += m * ((a["zero"] - q) ** 2 // q - base[:, row])
        return out + kept * base if tile == 0 else out

    a = side(low)
    b = a if low == high else side(high)
    for x, y in [(a, b)] if low == high else [(a, b), (b, a)]:
        value = pairs(x, y)
        i, j = np.nonzero(x["names"][:, None] != y["names"])
        found.append((x["names"][i], y["names"][j], value[i, j]))
    left, right, value = (np.concatenate([f[k] for f in found]) for k in range(3))
    return pa.table([pa.array([lang] * len(value), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair has every other source of the language; part term
    the top_terms terms of the source that are most above their share in the language. Ranks go by
    value, greatest first, and then by the item's bytes."""
    counts = materialize(term_counts(docs), "divergence-counts")
    present = counts.where("term IS NOT NULL")
    terms = present.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("in_lang"), F.count("*").alias("holders")).where(F.col("df") >= min_docs).drop("df")
    kept = materialize(present.drop("df").join(terms, ["lang", "term"]), "divergence-kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "divergence-groups")
    # A row for each language: its groups hold all occurrences of its kept terms.
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.sum("total").alias("lang_total"))
    sizes = sizes.join(terms.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    light = F.greatest(F.lit(LIGHT_LEAST), F.least(F.lit(LIGHT_GROUPS), F.floor(F.col("n_groups") / LIGHT_SHARE)))
    sizes = sizes.select("lang", "lang_total", F.coalesce("kept", F.lit(0)).alias("kept"), light.cast("long").alias("light"), F.ceil(F.col("n_groups") / BLOCK).alias("blocks"))
    sizes = materialize(sizes, "divergence-languages")
    # How many heavy and how many light terms each group has with each count.
    heavy = F.col("holders") > F.col("light")
    bars = kept.join(sizes.select("lang", "light"), "lang").groupBy("lang", "source", "n").agg(F.count_if(heavy).alias("heavy"), F.count_if(~heavy).alias("times"))
    bars = materialize(bars, "divergence-bars")
    rows = bars.groupBy("lang").agg((F.sum("heavy") + F.count_if(F.col("times") > 0)).alias("rows"))
    tiles = (1 + F.floor(F.coalesce("rows", F.lit(0)) / F.col("blocks") / TILE_ROWS)).cast("long")
    groups = materialize(groups.join(sizes, "lang").join(rows, "lang", "left").withColumn("tiles", tiles).drop("rows"), "divergence-groups")

    entries = kept.join(groups, ["lang", "source"])
    return _top_terms(entries, top_terms).unionByName(_pairs(entries, bars.join(groups, ["lang", "source"]), groups))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _top_terms(entries: DataFrame, most: int) -> DataFrame:
    own = share(F.col("n"), F.col("total"), F.col("kept"))
    all_ = share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    above = entries.select("lang", "source", "term", own.alias("p"), all_.alias("q")).where("p > q")
    return _ranked(above.select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")), "term").where(F.col("rank") <= most)


def _pairs(entries: DataFrame, bars: DataFrame, groups: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("long").alias("block")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    tile = lambda by: F.pmod(F.xxhash64(by), F.col("tiles")).alias("tile")
    zero = F.lit(0).cast("long")
    known = ("lang", "source", block, "blocks", "total", "kept")
    heads = groups.select(*known, F.lit(_HEADER).alias("part"), none("string", "term"), zero.alias("n"), zero.alias("times"), F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("tile"))
    full = entries.where(F.col("holders") > F.col("light")).select(*known, F.lit(_ENTRY).alias("part"), "term", "n", F.lit(1).cast("long").alias("times"), tile("term"))
    rare = bars.where("times > 0").select(*known, F.lit(_HISTOGRAM).alias("part"), none("string", "term"), "n", "times", tile("n"))
    rows = heads.unionByName(full).unionByName(rare)
    # A block meets each block once; a tile works out both directions.
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other", "blocks")
    dense = met.groupBy("lang", "low", "high", "tile").applyInArrow(_tile, _TILE)

    posting = F.struct("source", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(zero, F.col("total"), F.col("kept")).alias("z"))
    lists = entries.where("holders > 1 AND holders <= light").select("lang", "term", posting.alias("g")).groupBy("lang", "term").agg(F.collect_list("g").alias("gs"))
    shared = lists.select("lang", F.explode("gs").alias("a"), "gs").select("lang", "a", F.explode("gs").alias("b")).where("a.source <> b.source")
    f = lambda p, q: _apart(F.col(p), F.col(q))
    fix = f("a.p", "b.p") - f("a.p", "b.z") - f("a.z", "b.p") + f("a.z", "b.z")
    sparse = shared.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), fix.alias("value"))

    # Parts may pass 64 bits on the way to a sum that does not.
    wide = dense.unionByName(sparse).select("lang", "source", "item", F.col("value").cast("decimal(20,0)").alias("value"))
    return _ranked(wide.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")), "pair")


def audit(docs: DataFrame) -> DataFrame:
    """divergence with production parameters."""
    return divergence(docs)
