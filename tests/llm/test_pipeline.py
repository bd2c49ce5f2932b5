
import corpus_pipeline as P
from quarry.llm import quality as Q
from quarry.llm.common import materialize
from quarry.llm.tokens import encoder, public_path
from tests.llm import brute
from tests.llm.conftest import frame
from tests.llm.test_rules import plain_counts


def plain(rows):
    """What is left of (id, text) after the first four stages."""
    rows = [(i, Q.clean_lines(t or "")[0]) for i, t in rows if plain_counts(t)[-1]]
    best = {}
    for i, t in rows:
        best[brute.lower(t)] = max(i, best.get(brute.lower(t), i))
    rows = [(i, t) for i, t in rows if best[brute.lower(t)] == i]
    group = brute.components(rows, 4, 5)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    gone = brute.removals(rows, 100)
    return {i: gone[i][3].decode("utf-8", "ignore") for i, _ in rows}


def test_stages_equal_plain_forms(spark, docs, texts):
    rows = [(i, t) for i, t in texts if len(t or "") < 8000]
    now = docs.where("text IS NULL OR length(text) < 8000")
    for name, stage in P.STAGES[:-1]:
        now = materialize(stage(spark, now, ""), "test-" + name)
        assert now.columns == docs.columns
    left = {r.doc_id: r.text for r in now.collect()}
    want = plain(rows)
    assert left == want
    packed = P.STAGES[-1][1](spark, now, "").collect()
    encode = encoder(public_path("byte_bpe_50k.json")).encode
    lengths = {i: len(encode([t])[0]) // 4 + 1 for i, t in want.items()}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == lengths


def test_stages_take_an_empty_table(spark, empty):
    now = empty
    for name, stage in P.STAGES:
        now = materialize(stage(spark, now, ""), "test-" + name)
    assert now.count() == 0


def test_near_stage_takes_four_fifths(spark):
    """Of two texts that share 80 of 100 shingles one goes, of two that share 79 of 101 both stay."""
    words = [f"w{i}" for i in range(94)]
    pair = lambda name, same: (" ".join(words[: same + 4] + [f"{name}a{i}" for i in range(90 - same)]), " ".join(words[: same + 4] + [f"{name}b{i}" for i in range(90 - same)]))
    for same, left in ((80, 1), (79, 2)):
        texts = pair(f"n{same}", same)
        a, b = (brute.shingles(t) for t in texts)
        assert len(a & b) == same and len(a | b) == 180 - same
        assert P.near_dedup(spark, frame(spark, list(enumerate(texts))), "").count() == left
