"""Cuts of Korean against all cuts, and tokens of an index and its queries."""

import itertools
import random

from pyspark.sql import functions as F

from quarry.functions import segment as G
from quarry.functions import text as T

WORDS = ["타이밍", "마진", "측정", "온도", "고온", "내구성", "클럭", "경로", "제약", "소거"]
ENDS = ["은", "는", "을", "를", "에서", "으로", ""]


def test_cut_is_the_cheapest_of_all():
    rng = random.Random(3)
    for _ in range(60):
        run = "".join(rng.choice("가나다") for _ in range(rng.randint(1, 8)))
        table = G.costs({"".join(rng.choice("가나다") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(8)})
        cost = lambda pieces: sum(table.get(p, table[""] + 1 if len(p) == 1 else float("inf")) for p in pieces)
        cuts = [[run[a:b] for a, b in zip((0, *at), (*at, len(run)))] for k in range(len(run)) for at in itertools.combinations(range(1, len(run)), k)]
        got = G.cut(run, table)
        assert "".join(got) == run and abs(cost(got) - min(map(cost, cuts))) < 1e-9
    assert G.cut("", {}) == [] and G.cut("가나", {}) == ["가", "나"]


def corpus(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.3 else "") + rng.choice(ENDS) for _ in range(12)) + " NFC 12ns" for _ in range(150)]
    return spark.createDataFrame([(t,) for t in [*texts, None, "", "no hangul"]], "text string").repartition(3)


def test_words_are_learnt_and_found(spark):
    counts = G.learn(corpus(spark))
    assert all(w in counts for w in WORDS) and len(counts) <= G.MOST
    table = G.costs(counts)
    assert G.cut("타이밍마진을", table) == ["타이밍", "마진", "을"] and G.cut("고온에서", table) == ["고온", "에서"]
    assert G.learn(corpus(spark).where("text IS NULL")) == {}


def test_index_and_query_agree(spark):
    counts = G.learn(corpus(spark))
    asked = spark.createDataFrame([("타이밍마진측정을 NFC",), ("클럭경로에서",), (None,)], "text string")
    text = F.coalesce("text", F.lit(""))
    rows = asked.select(T.mixed_tokens(text, G.korean_tokens(counts)).alias("i"), T.legacy_query_tokens(text, G.korean_tokens(counts, query=True)).alias("q")).collect()
    assert rows[0].i == ["타이밍", "마진", "측정", "nfc"] == rows[0].q
    # Where a text has nothing English, what stands between spaces is a token too.
    assert rows[1].i == ["클럭", "경로", "에서", "클럭경로에서"] and rows[1].q == ["클럭", "경로", "클럭경로에서"]
