"""Korean words from a table of pieces that a corpus teaches.

A run of Hangul is cut where the pieces are most likely, by dynamic programming over a table of pieces
and their counts; a single character is always a piece. The table is learnt from the corpus: substrings
of its runs that occur often are candidates, and rounds of cutting all runs with the table and counting
again leave those that are used. The same cut serves the index and the query, whose tag filter leaves
out particles and endings that follow a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece, occurrences of a candidate, and pieces of a table at most: what is sent to tasks.
LONGEST, LEAST, MOST = 6, 3, 50_000
ROUNDS = 3
#: A candidate is two words, or a word and a particle, where each of them is so many times as frequent.
OFTENER = 2
#: A piece's chance is that of its count; one that was never counted has this share of a count.
UNSEEN = 0.1

# Particles and endings that are no content.
PARTICLES = frozenset("은 는 이 가 을 를 의 에 에서 에게 으로 로 와 과 도 만 까지 부터 보다 처럼 마다 이나 나 이다 입니다 합니다 하는 하고 하여 한다 했다 된다 되는 되고 인 및 들".split())

Table = dict[str, float]


def costs(counts: dict[str, int]) -> Table:
    """Negative log chances of pieces."""
    total = sum(counts.values()) + UNSEEN
    return {piece: math.log(total / n) for piece, n in counts.items()} | {"": math.log(total / UNSEEN)}


def cut(run: str, table: Table) -> list[str]:
    """The likeliest pieces of a run of Hangul; of equally likely cuts the one with longer first pieces."""
    unseen = table.get("", 0.0) + 1.0
    best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
    for at in range(len(run) - 1, -1, -1):
        found = (math.inf, 1)
        for size in range(1, min(LONGEST, len(run) - at) + 1):
            cost = table.get(run[at : at + size], unseen if size == 1 else None)
            if cost is not None and cost + best[at + size][0] <= found[0]:
                found = (cost + best[at + size][0], size)
        best[at] = found
    out, at = [], 0
    while at < len(run):
        out.append(run[at : at + best[at][1]])
        at += best[at][1]
    return out


def runs_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """run, n: the different runs of Hangul and how often each occurs; a row for each, not for each place."""
    each = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("([가-힣]+)"))).alias("run"))
    return each.groupBy("run").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, text: str = "text", least: int = LEAST, most: int = MOST, rounds: int = ROUNDS) -> dict[str, int]:
    """Counts of the pieces of a corpus; empty where it has no Hangul. The driver holds `most` pieces at
    most, and what is counted are all runs."""
    runs = runs_of(docs, text)
    size = F.length("run")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - a + 1)), lambda n: F.substring("run", a, n))))
    counted = runs.select(F.explode(spans).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = _single(_first(counted.where(F.col("n") >= least), most))
    for _ in range(rounds if counts else 0):
        table = costs(counts)

        def pieces(frames: Iterator[pd.DataFrame], table: Table = table) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame([(p, n) for run, n in zip(frame["run"], frame["n"]) for p in cut(run, table)], columns=["piece", "n"])

        used = runs.mapInPandas(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = _first(used, most)
    return counts


def _single(counts: dict[str, int]) -> dict[str, int]:
    """Candidates without those that are two: frequent compounds, and words with their particles."""

    def two(piece: str) -> bool:
        parts = ((piece[:k], piece[k:]) for k in range(2, len(piece)))
        return any((len(b) > 1 or b in PARTICLES) and min(counts.get(a, 0), counts.get(b, 0)) >= OFTENER * counts[piece] for a, b in parts)

    return {piece: n for piece, n in counts.items() if not two(piece)}


def _first(counted: DataFrame, most: int) -> dict[str, int]:
    rows = counted.orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(most).collect()
    return {r["piece"]: r["n"] for r in rows}


def korean_tokens(counts: dict[str, int], query: bool = False):
    """A tokenizer (a column of texts to an array of words) for the mixed tokens of an index or a query:
    pieces of two characters or more, for a query without particles."""
    table = costs(counts) if counts else {}

    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([[p for run in (() if runs is None else runs) for p in cut(run, table) if len(p) >= 2 and not (query and p in PARTICLES)] for runs in texts])

    def tokenize(text: Column) -> Column:
        return F.pandas_udf(words, "array<string>")(F.regexp_extract_all(text, F.lit("([가-힣]+)")))

    return tokenize
