"""Base spans against plain regular expressions, the estimation against a plain one, and added spans against a known truth."""

import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import pii as P
from tests.llm.conftest import frame, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, rule in PLAIN.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = [
    "a@b.c_d@e.f a@b.c@d.e x@y @z.w a.b@c-d.e.f. x@-y.z-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3 1..2.3.4 00256.1.1.1 9.9.9.9999",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 2023 4111 1111 1111 1111",
    "+1 (663) 555-6869 +12 +1-2 +44 20 7946 0958 and ++33 1 23 45 67 89. +123456789012345678",
    "é ü mail: jörg@web.de İ x+y%z@host.example.org 10.0.0.1é +49é",
]


def test_base_spans(spark, docs, texts):
    rng = random.Random(3)
    drawn = ["".join(rng.choice("aZ9.@+- ()é_%\n01") for _ in range(200)) for _ in range(300)]
    rows = texts + [(10_000 + i, t) for i, t in enumerate(ODD + drawn)]
    got = {r.doc_id: r for r in P.report(frame(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = plain_base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(w.startswith(k) for w in want) for k in P.KINDS]
        assert set(want) <= set(filter(None, got[i].spans.split(",")))


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " + "(" * 300_000, "a@" * 100_000, "1 " * 150_000, "(12) " * 60_000, "a at b " * 40_000])
def test_scans_are_linear(text):
    """Each takes a fraction of a second; a quadratic scan would not end in minutes."""
    P.base_spans(text)
    list(P.loose_spans(text))


def test_odd_rows(spark, odd, empty, texts):
    assert P.report(odd).count() == len(texts) + 4
    assert P.report(empty).collect() == []
    r = P.report(frame(spark, [(None, None), (1, ""), (1, "")])).collect()
    assert [(x.spans, x.n_email, x.n_added) for x in r] == [("", 0, 0)] * 3


def test_estimation_by_patterns_is_that_by_items():
    """Expectation-maximisation on counts of patterns equals that on each item."""
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.95])
    votes = np.where(rng.random((4000, 4)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, chances, prior = P.reliabilities(patterns, counts.astype(float))
    each, chances_each, _ = P.reliabilities(votes, np.ones(4000))
    assert np.allclose(post[inverse.ravel()], each, atol=1e-6) and np.allclose(chances, chances_each, atol=1e-6)
    assert ((each > 0.5) == truth).mean() > 0.9 and abs(prior[1] - 0.3) < 0.03
    assert abs(chances[1, 3, 2] / (1 - chances[1, 3, 1]) - 0.95) < 0.03  # the share of right votes of those given


def _made(rng, i):
    """(text, true loose spans): a truth, a decoy, or plain prose."""
    lead, tail = prose(rng, 12), prose(rng, 8)
    number = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    name, host = rng.choice(["anna", "j.smith", "max_m"]) + number(2), rng.choice(["web", "mail", "corp"]) + number(1)
    true = [
        ("mail me: ", f"{name} [at] {host} [dot] {rng.choice(['com', 'de', 'fr'])}"),
        ("contact ", f"{name} at {host} dot {rng.choice(['com', 'org'])}"),
        ("phone: ", f"({rng.choice('23456789')}{number(2)}) 555-{number(4)}"),
        ("tel. ", f"0{rng.choice('1234567')} {number(2)} {number(2)} {number(2)} {number(2)}"),
        ("login from host ", f"{rng.randint(21, 223)}[.]{rng.randint(1, 255)}[.]{rng.randint(1, 255)}[.]{rng.randint(1, 254)}"),
    ]
    decoy = [
        ("published ", f"{rng.randint(1900, 2024)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        ("order ", f"{number(3)}-{number(7)}-{number(4)}"),
        ("version ", f"{number(2)}.{number(2)}.{number(3)}"),
        ("look ", f"at {rng.choice(['home', 'once'])}.Then"),
        ("pages ", f"{number(3)}-{number(4)}"),
    ]
    kind = i % 4
    cue, span = rng.choice(true) if kind == 0 else rng.choice(decoy) if kind == 1 else ("", "")
    extra = f" write to {name}@{host}.com or call +1 (212) 555-{number(4)} " if kind == 2 else ""
    start = len(lead) + 1 + len(cue)
    return f"{lead} {cue}{span}{extra} {tail}", {(start, start + len(span))} if kind == 0 else set()


def test_added_spans_against_a_truth(spark):
    rng = random.Random(11)
    made = [_made(rng, i) for i in range(1200)]
    got = {r.doc_id: r for r in P.report(frame(spark, [(i, t) for i, (t, _) in enumerate(made)]).repartition(4)).collect()}
    hit = wrong = 0
    for i, (text, true) in enumerate(made):
        base = set(plain_base(text))
        added = {tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s and s not in base}
        assert len(added) == got[i].n_added
        hit += len(added & true)
        wrong += len(added - true)
    assert hit >= 0.9 * sum(len(t) for _, t in made), (hit, wrong)
    assert wrong <= 0.05 * hit, (hit, wrong)


def test_overlaps_by_a_plain_form():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(12))]
        taken, plain = P.Taken(spans[:3]), spans[:3]
        for a, b in spans[3:]:
            free = not any(x < b and a < y for x, y in plain)
            assert taken.add(a, b) == free
            if free:
                plain.append((a, b))
