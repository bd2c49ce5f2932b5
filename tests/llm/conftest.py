import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, block string, tie string, kept string, rep string, h string, key string"


def prose(rng, n):
    out = []
    while len(out) < n:
        sentence = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(5, 12))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out)


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def texts():
    """(id, text): copies, near copies of many degrees, shared passages, and odd texts."""
    rng = random.Random(7)
    passage = prose(rng, 60)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(12)]
    out = list(base)
    out += [b.upper() for b in base[:3]] + [base[0]] * 4
    out += [edited(rng, base[1], s / 400) for s in range(0, 30)]
    out += [edited(rng, base[2], 0.02) for _ in range(12)]
    out += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 15) for _ in range(8)]
    out += ["", None, " \n\t ", "one", "one two three", "a" * 700, "é" * 300, "straße ÄÖ İ ß " * 30, "x\n" * 60]
    out += [passage * 3, "|".join(WORDS * 4), "<|endoftext|> text  with   spaces \r\n\x0b tabs\t"]
    out += [" ".join(prose(rng, 40) for _ in range(80))]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return [(i * 3, t) for i, t in zip(ids, out)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["clash"] * 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).repartition(5)


@pytest.fixture(scope="session")
def odd(spark, texts):
    """The same with a row repeated and rows without an id."""
    return frame(spark, texts + texts[3:4] + [(None, texts[4][1]), (None, None), (None, "only here")]).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
