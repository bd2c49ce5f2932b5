"""Personal data: plain rules, and spans that a classifier adds which weak labels have trained.

The base rules find e-mail addresses, IPv4 addresses, card and phone numbers, and all that they find
stays. Beside them stand candidates of looser forms: written-out addresses, numbers without a country
code, cards among other digits. On each candidate, base ones too, LABELERS vote for, against or not at
all: regular expressions (its layout), gazetteers (top-level domains, calling codes, issuers, reserved
networks) and the words around it. Expectation-maximisation estimates how reliable every labeler is
for each kind from how often each pattern of votes occurs in the corpus; a pattern's probability then
labels the sample from which a logistic regression over the span's own shape and words is trained. It
decides on the candidates that no base rule found.

One pass reads the texts and leaves spans, votes and features, no text, in a table; the model is made
of the counts of its patterns, at most 3^8 for each kind, and of at most SAMPLE_ROWS candidates, and
the second pass reads that table alone. All scans are linear in the text's length.

Odd rows: a null text is an empty one without spans; a null doc_id stays null and repeated rows are
each reported; a table without candidates trains nothing and adds nothing. Other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, slices

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the classifier's sample: candidates of each kind and pattern of votes, and of all.
SAMPLE_EACH, SAMPLE_ROWS = 100, 20_000
FEATURES = 2048
THRESHOLD = 0.5
AROUND = 48

# The base rules. Lookbehinds and possessive runs only spare attempts that must fail.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL_HERE = re.compile(_LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL = re.compile(rf"(?<!{_LOCAL})" + _EMAIL_HERE.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]|\sat\s", re.I)
_WORDED_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s)"
    r"[A-Za-z0-9-]{1,63}+(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)[A-Za-z0-9-]{2,63}+){1,4}",
    re.I,
)
_WORDED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[(]\s?(?:dot|\.)\s?[\])]\s?[0-9]{1,3}){3}(?![0-9])", re.I)
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_CARD_FORM = re.compile(r"(?<![0-9])(?:[0-9]{4}([ .\-/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ .\-/])[0-9]{6}\2[0-9]{5})(?![0-9])")
_PHONE_FORM = re.compile(r"(?<![\w.+,])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .\-/]{1,2}[0-9]{2,8}+){1,5}(?![\w])")

_LUHN = np.array([[d, d * 2 - 9 * (d > 4)] for d in range(10)]).tolist()


def luhn(digits: str) -> bool:
    return sum(_LUHN[int(d)][i & 1] for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        # After a match the next one may begin in the middle of a run.
        m = _EMAIL_HERE.match(text, at) if at else None
        m = m or _EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def _ip_fits(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules by kind and start, in code points."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if _ip_fits(m[0])]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    return out + [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else out


def loose_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of candidates of looser forms; they may overlap base ones and each other."""
    if _AT.search(text):
        yield from ((0, *m.span()) for m in _WORDED_EMAIL.finditer(text))
    if "[" in text or "(" in text:
        yield from ((1, *m.span()) for m in _WORDED_IP.finditer(text))
    if ":" in text:
        yield from ((1, *m.span()) for m in _IP6.finditer(text))
    yield from ((2, *m.span()) for m in _CARD_FORM.finditer(text))
    yield from ((3, *m.span()) for m in _PHONE_FORM.finditer(text) if 7 <= len(_digits(m[0])) <= 15)


# ---- labelers -----------------------------------------------------------------------------------------

# Gazetteers.
DOMAINS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg se no dk fi ee lv lt ru ua tr il in cn jp kr tw hk sg br mx ar cl pe za eg ng ke".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421 971 972".split())
ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
RESERVED = re.compile(r"(?:0|127|22[4-9]|2[3-5][0-9])\.")
# Words near personal data of each kind, and words near numbers that are none.
CUES = tuple(
    re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.I)
    for words in (
        "e-?mails?|mail|contact|write to|reach|courriel|adresse|kontakt|schreib\\w*|correo|contacto|escrib\\w*",
        "ip|ips|host|server|client|login|address|serveur|adresse|servidor|direcci[oó]n",
        "cards?|visa|mastercard|amex|credit|debit|carte|karte|kreditkarte|tarjeta",
        "tel|tél|phone|telephone|call|fax|mobile|cell|dial|sms|whatsapp|téléphone|appel\\w*|telefon|handy|ruf\\w*|anruf\\w*|teléfono|móvil|llam\\w*",
    )
)
NONE = re.compile(r"(?<!\w)(?:isbn|issn|doi|version|v|release|order|invoice|rfc|section|chapter|page|pages|pp|vol|no|art|lot|serial|build|id|price|total|sum|score|date|commande|facture|rechnung|seite|pedido|factura)\W{0,3}$|[$€£#=]\s?$", re.I)
_DATE = re.compile(r"(?:(?:1[89]|20)[0-9]{2}[ .\-/][01]?[0-9][ .\-/][0-3]?[0-9]|[0-3]?[0-9][ .\-/][01]?[0-9][ .\-/](?:1[89]|20)[0-9]{2})(?:\D.*)?|(?:1[89]|20)[0-9]{2}[ \-/](?:1[89]|20)?[0-9]{2}")
_PHONE_LAYOUT = re.compile(r"\+.*|\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|00[1-9][0-9]*[ .\-/].*|\(?0[0-9]{2,4}\)?[ \-/]{1,2}[0-9]{4,8}|[6-9][0-9]{2} [0-9]{3} [0-9]{3}|[6-9][0-9]{2}(?: [0-9]{2}){3}")
_CARD_LAYOUT = re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -]?)[0-9]{6}\2[0-9]{5}")

LABELERS = ("strict", "layout", "check", "gazetteer", "before", "after", "none", "edges")


def votes(kind: int, span: str, before: str, after: str, strict: bool) -> tuple[int, ...]:
    """What each of LABELERS says of a span and the text around it: 1, -1 or 0."""
    digits = _digits(span)
    if kind == 0:
        layout = 1 if "@" in span or re.search(r"[\[({<]\s?at", span, re.I) else (-1 if " dot " not in span.lower() else 1)
        names = re.split(r"[^A-Za-z0-9-]+", span)
        check = -1 if len(names) < 3 or any(n.startswith("-") for n in names) else (1 if names[-1].isalpha() and 2 <= len(names[-1]) <= 6 else -1)
        gazetteer = 1 if names[-1].lower() in DOMAINS else -1
    elif kind == 1:
        parts = [int(p) for p in re.findall(r"[0-9]{1,3}", span)] if ":" not in span else []
        layout = 1 if re.fullmatch(r"(?:[1-9][0-9]{0,2}|0)(?:\D+(?:[1-9][0-9]{0,2}|0)){3}", span) or ":" in span else -1
        check = 1 if all(p <= 255 for p in parts) and any(p > 20 for p in parts) or ":" in span else -1
        gazetteer = -1 if RESERVED.match(span) else 0
    elif kind == 2:
        layout = 1 if _CARD_LAYOUT.fullmatch(span) else 0
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if ISSUER.match(digits) else -1
    else:
        layout = -1 if _DATE.fullmatch(span) else (1 if _PHONE_LAYOUT.fullmatch(span) else 0)
        check = 1 if 9 <= len(digits) <= 13 else -1
        code = digits[2:] if digits.startswith("00") else digits
        gazetteer = (1 if any(code[:k] in CALLING_CODES for k in (1, 2, 3)) else -1) if span[0] == "+" or digits.startswith("00") else 0
    glued = (before[-1:].isalnum() or before[-1:] in ("_", "/")) or (after[:1].isalnum() or after[:1] in ("_", "/") or bool(re.match(r"[.,:-][0-9]", after)))
    return (1 if strict else 0, layout, check, gazetteer, 1 if CUES[kind].search(before) else 0, 1 if CUES[kind].search(after) else 0, -1 if NONE.search(before) else 0, -1 if glued else 1)


_RUN = re.compile(r"9+|a+")
_TO_SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}})


def features(kind: int, span: str, before: str, after: str) -> list[int]:
    """Hashed features of a span: its shape, its size, what it is made of and the words beside it."""
    shape = _RUN.sub(lambda m: m[0][0] + str(min(len(m[0]), 9)), span.translate(_TO_SHAPE))
    left, right = re.findall(r"\w+", before.lower())[-2:], re.findall(r"\w+", after.lower())[:1]
    words = re.findall(r"[a-z]+", span.lower())
    found = [f"s{shape}", f"n{len(_digits(span))}", f"l{min(len(span) // 4, 12)}", f"a{span[:1].translate(_TO_SHAPE)}", f"d{_digits(span)[:2]}", f"e{words[-1] if words else ''}"]
    found += [f"b{before[-1:].translate(_TO_SHAPE)}", f"f{after[:1].translate(_TO_SHAPE)}", *(f"p{w}" for w in left), *(f"q{w}" for w in right), f"c{bool(CUES[kind].search(before))}", f"x{bool(NONE.search(before))}"]
    if kind == 2:
        found.append(f"u{luhn(_digits(span))}")
    return sorted({zlib.crc32(f"{KINDS[kind]}:{f}".encode()) % FEATURES for f in found} | {FEATURES + kind})


_CANDIDATES = "doc_id long, counts array<long>, base string, candidates array<struct<kind: int, start: int, end: int, strict: boolean, votes: string, features: array<int>>>"
_FIELDS = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]
_DIGIT = re.compile("[0-9]")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts, bases, lists = [], [], []
        for text in batch.column("text").to_pylist():
            found: list[dict] = []
            base: list[tuple[int, int, int]] = []
            if text and ("@" in text or _DIGIT.search(text) or _AT.search(text)):
                base = base_spans(text)
                strict = set(base)
                for kind, a, b in [*base, *(s for s in loose_spans(text) if s not in strict)]:
                    before, span, after = text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]
                    said = "".join("-0+"[v + 1] for v in votes(kind, span, before, after, (kind, a, b) in strict))
                    found.append({"kind": kind, "start": a, "end": b, "strict": (kind, a, b) in strict, "votes": said, "features": features(kind, span, before, after)})
            counts.append([sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))])
            bases.append(joined(base))
            lists.append(found)
        columns = [batch.column("doc_id"), pa.array(counts, pa.list_(pa.int64())), pa.array(bases, pa.string()), pa.array(lists, pa.list_(pa.struct(_FIELDS)))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "counts", "base", "candidates"])


def candidates(docs: DataFrame) -> DataFrame:
    """_CANDIDATES of docs (doc_id, text): base spans, their numbers by kind, and every candidate with
    its votes and features."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_candidates, _CANDIDATES)


# ---- estimation ---------------------------------------------------------------------------------------


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each pattern to be personal data, chances of votes, prior) by expectation-maximisation.

    patterns (m, labelers) of -1, 0, 1 with their counts. Votes are independent given the class; chances
    [class, labeler, vote + 1] start from the majority of votes and keep a weak belief that labelers are
    right more often than wrong.
    """
    lean = patterns.sum(axis=1)
    post = np.clip(0.5 + 0.4 * np.sign(lean), 0.1, 0.9).astype(float)
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=-1).astype(float)
    belief = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])[:, None, :]
    chances = prior = None
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        chances = np.einsum("cm,mlv->clv", w, hot) + belief
        chances /= chances.sum(axis=2, keepdims=True)
        prior = (w.sum(axis=1) + 1) / (w.sum() + 2)
        score = np.einsum("mlv,clv->cm", hot, np.log(chances)) + np.log(prior)[:, None]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -60, 60)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, chances, prior


def fit_classifier(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on sparse binary features with soft labels."""
    flat = np.concatenate([np.asarray(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, seen = np.zeros(FEATURES + len(KINDS)), np.full(FEATURES + len(KINDS), 1e-8)
    weight = weight / weight.sum()
    for _ in range(steps):
        z = np.bincount(row, w[flat], len(rows))
        slope = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) * weight
        grad = np.bincount(flat, slope[row], len(w)) + decay * w
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
    return w


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier, and what was estimated of the labelers of each kind."""

    weights: np.ndarray
    chances: dict[str, np.ndarray]
    priors: dict[str, float]

    def probability(self, active: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[active].sum(), -60, 60))))


def train(found: DataFrame) -> Model | None:
    """The model of a table of candidates; none where it has no candidates. Every candidate counts in the
    patterns; what is sampled are rows for the classifier, the first by a hash of each kind and pattern,
    weighted by how many they stand for."""
    each = found.select("doc_id", F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features", F.xxhash64("doc_id", "c.start", "c.end", "c.features").alias("order"))
    counted = sorted((r["kind"], r["votes"], r["count"]) for r in each.groupBy("kind", "votes").count().collect())
    if not counted:
        return None
    label, chances, priors = {}, {}, {}
    for kind in range(len(KINDS)):
        own = [(v, n) for k, v, n in counted if k == kind]
        if own:
            votes_ = np.array([["-0+".index(c) - 1 for c in v] for v, _ in own])
            post, chances[KINDS[kind]], prior = reliabilities(votes_, np.array([n for _, n in own], float))
            priors[KINDS[kind]] = float(prior[1])
            label |= {(kind, v): p for (v, _), p in zip(own, post)}
    w = Window.partitionBy("kind", "votes").orderBy("order")
    first = each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= SAMPLE_EACH)
    sample = first.orderBy("place", "order", "kind", "votes").limit(SAMPLE_ROWS).collect()
    stands: dict[tuple[int, str], int] = {}
    for r in sample:
        stands[r["kind"], r["votes"]] = stands.get((r["kind"], r["votes"]), 0) + 1
    many = {(k, v): n for k, v, n in counted}
    keys = [(r["kind"], r["votes"]) for r in sample]
    target = np.array([label[k] for k in keys])
    weight = np.array([(many[k] / stands[k]) ** 0.5 for k in keys])
    return Model(fit_classifier([r["features"] for r in sample], target, weight), chances, priors)


class Taken:
    """Stretches of a text, apart from each other and in order."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, start: int, end: int) -> bool:
        """Whether start to end was free; it is taken then."""
        i = bisect.bisect_left(self.starts, end)
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def _decided(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added, out = [], []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist()):
                kept = sorted((c["kind"], c["start"], c["end"]) for c in found if c["strict"])
                loose = [] if model is None else [(model.probability(c["features"]), c) for c in found if not c["strict"]]
                more = 0
                # What overlaps a base span, or a likelier one that was added, is not added.
                taken = Taken((a, b) for _, a, b in kept)
                for p, c in sorted(loose, key=lambda x: (-x[0], x[1]["start"], x[1]["kind"])):
                    if p >= threshold and taken.add(c["start"], c["end"]):
                        kept.append((c["kind"], c["start"], c["end"]))
                        more += 1
                added.append(more)
                out.append(joined(sorted(kept)) if more else base)
            columns = [batch.column("doc_id"), batch.column("counts"), batch.column("base"), pa.array(out, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "counts", "base", "spans", "n_added"])

    return run


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts (of base spans by KINDS), base, spans, n_added of every document; base and spans are
    kind:start:end by kind and start, joined by commas, in code points, ends exclusive."""
    found = materialize(candidates(docs), "pii")
    return found.mapInArrow(_decided(train(found), threshold), "doc_id long, counts array<long>, base string, spans string, n_added long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    numbers = [F.col("counts")[i].alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return find_personal_data(docs).select("doc_id", *numbers, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
