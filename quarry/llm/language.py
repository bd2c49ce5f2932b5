"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read as segments of SEGMENT bytes, each from both ends; at every byte the two states give
probabilities of the languages, and a document's answer pools those of all its bytes. Training is
backpropagation through time with Adam on a bounded sample of labelled rows, once, on the driver, which
draws segments from anywhere in the rows' whole texts; all texts are labelled in full by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, string_buffers

SEGMENT = 64
HIDDEN = 8
#: Bound of the training sample: labelled rows of each language, and of all. Where there are so many
#: languages that the second is less, each has its share of it and one row at least; none is left out.
SAMPLE_ROWS = 400
SAMPLE_TOTAL = 25_600
#: Tasks that a language's rows are dealt over while the sample is taken.
SHARES = 64
STEPS = 240
BATCH = 256
RATE = 0.02
#: Segments that run side by side.
LANES = 8192

_PAD = 256
_LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def tables(rng: np.random.Generator, hidden: int, classes: int) -> dict[str, np.ndarray]:
    """Fresh weights. Rows of three gates: update, reset, candidate; columns are lanes."""
    made = {}
    for side in "fb":
        made["x" + side] = rng.normal(0, 0.3, (3 * hidden, _PAD + 1))
        made["h" + side] = rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden))
        made["o" + side] = rng.normal(0, 0.3, (classes, hidden))
    made["b"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in made.items()}


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function of candidates, and halved and raised of gates."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def quiet_pad(w: dict[str, np.ndarray], hidden: int) -> None:
    """Give padding inputs that set the state to nothing, so that they change no other byte."""
    for side in "fb":
        w["x" + side][: 2 * hidden, _PAD] = -1e9
        w["x" + side][2 * hidden :, _PAD] = 0


def forward(w: dict[str, np.ndarray], codes: np.ndarray, side: str, keep: list | None = None) -> list[np.ndarray]:
    """States after each byte; codes is (segment, lanes). The b side reads from the end."""
    x, u = w["x" + side], w["h" + side]
    n = u.shape[1]
    h = np.zeros((n, codes.shape[1]), np.float32)
    a = np.empty((3 * n, codes.shape[1]), np.float32)
    out: list = [None] * len(codes)
    for t in range(len(codes)) if side == "f" else range(len(codes) - 1, -1, -1):
        np.take(x, codes[t], axis=1, out=a, mode="clip")
        g = u @ h
        zr = g[: 2 * n]
        zr += a[: 2 * n]
        zr = soft(zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:n], zr[n:]
        c = r * g[2 * n :]
        c += a[2 * n :]
        c = soft(c)
        new = h - c
        new *= z
        new += c
        if keep is not None:
            keep.append((t, h, z, r, c, g[2 * n :]))
        h = out[t] = new
    return out


def probabilities(w: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """(segment, classes, lanes) of each byte."""
    logits = np.empty((len(codes), len(w["b"]), codes.shape[1]), np.float32)
    for t, h in enumerate(forward(w, codes, "f")):
        np.matmul(w["of"], h, out=logits[t])
    for t, h in enumerate(forward(w, codes, "b")):
        logits[t] += w["ob"] @ h
    logits += w["b"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over all bytes that are not padding."""
    n = w["hf"].shape[1]
    kept: dict[str, list] = {"f": [], "b": []}
    states = {side: forward(w, codes, side, kept[side]) for side in "fb"}
    real = (codes != _PAD).astype(np.float32)
    scale = real / max(real.sum(), 1)
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    dlogit = []
    for t in range(len(codes)):
        s = w["of"] @ states["f"][t] + w["ob"] @ states["b"][t] + w["b"]
        p = np.exp(s - s.max(axis=0))
        p /= p.sum(axis=0)
        p[labels, np.arange(codes.shape[1])] -= 1
        p *= scale[t]
        dlogit.append(p)
        grad["b"] += p.sum(axis=1, keepdims=True)
        for side in "fb":
            grad["o" + side] += p @ states[side][t].T
    for side in "fb":
        u = w["h" + side]
        dh = np.zeros_like(states[side][0])
        for t, h, z, r, c, g in reversed(kept[side]):
            dh = dh + w["o" + side].T @ dlogit[t]
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * g * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            da = np.concatenate([dz, dr, dc])
            dg = np.concatenate([dz, dr, dc * r])
            for k in range(3 * n):
                grad["x" + side][k] += np.bincount(codes[t], weights=da[k], minlength=_PAD + 1)
            grad["h" + side] += dg @ h.T
            dh = dh * z + u.T @ dg
    return grad


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def train(rows: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 5) -> Model:
    """Fit on (bytes, language) rows; every language is drawn equally often."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], {})
    rng = np.random.default_rng(seed)
    w = tables(rng, hidden, len(languages))
    quiet_pad(w, hidden)
    by = [np.concatenate([segments([text]) for text, lang in rows if lang == own]) for own in languages]
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), BATCH)
        codes = np.stack([by[k][rng.integers(0, len(by[k]))] for k in labels], axis=1)
        grad = gradients(w, codes, labels)
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grad.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        quiet_pad(w, hidden)
    return Model(languages, w)


def segments(texts: list[bytes]) -> np.ndarray:
    """(segments, SEGMENT) codes of texts one after the other, padded at their ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // SEGMENT)
    out = np.full(int(count.sum()) * SEGMENT, _PAD, np.int16)
    starts = (np.cumsum(count) - count) * SEGMENT
    for t, s in zip(texts, starts.tolist()):
        out[s : s + len(t)] = np.frombuffer(t, np.uint8)
    return out.reshape(-1, SEGMENT)


def pooled(model: Model, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Summed byte probabilities (texts, languages) for each (bytes, offsets)."""
    for raw, offsets in batches:
        sizes = np.diff(offsets)
        count = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), count)
        lead = np.cumsum(count) - count
        begin = offsets[:-1][owner] + (np.arange(len(owner)) - lead[owner]) * SEGMENT
        length = np.minimum(offsets[1:][owner] - begin, SEGMENT)
        total = np.zeros((len(sizes), len(model.languages)))
        reach = np.arange(SEGMENT)[:, None]
        for at in range(0, len(owner), LANES):
            b, n, o = begin[at : at + LANES], length[at : at + LANES], owner[at : at + LANES]
            real = reach < n
            codes = np.where(real, raw[np.minimum(b + reach, len(raw) - 1)], np.intp(_PAD))
            p = probabilities(model.weights, codes)
            p *= real[:, None, :]
            per = p.sum(axis=0, dtype=np.float64).T
            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            total[o[first]] += np.add.reduceat(per, first, axis=0)
        yield total


def label_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, text -> doc_id, held_out, lang_pred, score."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            known = [bool(t and model.languages and _LETTER.search(t)) for t in texts]
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if any(known):
                sums = next(pooled(model, iter([string_buffers(batch.column("text"))])))
                share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)
                best = share.argmax(axis=1)
                for i, k in enumerate(known):
                    if k:
                        lang[i], score[i] = model.languages[best[i]], min(1.0, float(share[i, best[i]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"]
            )


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """Segments to train on, with their languages: as many as training draws, each any segment of the
    whole texts of at most SAMPLE_ROWS rows of a language, the first by a hash of the id.

    The rows are written once; the driver sees their sizes, says which segments are drawn, and gets
    those, so a very long text takes no more of its memory than a short one.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("mark"), F.xxhash64("text").alias("of"), "text")
    # First within SHARES shares of a language, then among what these leave: no task sees all of one.
    order = ["mark", "doc_id", "of"]
    share = Window.partitionBy("lang", F.pmod("doc_id", F.lit(SHARES))).orderBy(*order)
    few = rows.drop("text").withColumn("n", F.row_number().over(share)).where(F.col("n") <= SAMPLE_ROWS)
    first = Window.partitionBy("lang").orderBy(*order)
    keys = materialize(few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_ROWS).drop("mark"), "language-keys")
    # Texts stay where they are; those of the keys, a few hundred of each language, are written once.
    taken = rows.drop("mark").join(keys, ["lang", "doc_id", "of"]).dropDuplicates(["lang", "n"])
    taken = materialize(taken.select("lang", "n", F.octet_length("text").alias("size"), "text"), "language-sample")
    sizes: dict[str, dict[int, int]] = {}
    for r in taken.select("lang", "n", "size").collect():
        sizes.setdefault(r["lang"], {})[r["n"]] = -(-r["size"] // SEGMENT)
    drawn = draws(sizes)
    if not drawn:
        return []
    asked = taken.sparkSession.createDataFrame(drawn, "lang string, n int, parts array<int>")
    cut = taken.join(asked, ["lang", "n"]).select("lang", F.encode("text", "UTF-8").alias("raw"), F.explode("parts").alias("part"))
    found = cut.select("lang", F.substring("raw", F.col("part") * SEGMENT + 1, F.lit(SEGMENT)).alias("segment")).collect()
    return sorted((bytes(r["segment"]), r["lang"]) for r in found)


def draws(sizes: dict[str, dict[int, int]], seed: int = 11) -> list[tuple[str, int, list[int]]]:
    """(language, row, segments) of as many segments of each language as training draws of it, from rows
    with so many segments, evenly over all of a language's segments."""
    each = max(1, min(SAMPLE_ROWS, SAMPLE_TOTAL // max(len(sizes), 1)))
    rng, out = np.random.default_rng(seed), []
    for lang in sorted(sizes):
        rows = sorted(sizes[lang])[:each]
        ends = np.cumsum([sizes[lang][r] for r in rows])
        want = min(int(ends[-1]), -(-STEPS * BATCH // len(sizes)))
        picked = np.sort(rng.choice(int(ends[-1]), want, replace=False))
        row = np.searchsorted(ends, picked, side="right")
        begin = ends - [sizes[lang][r] for r in rows]
        out += [(lang, int(rows[k]), [int(p - begin[k]) for p in picked[row == k]]) for k in np.unique(row)]
    return out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang).

    The model learns from text and lang of rows that are not held out and have both; it reads
    texts alone. Null texts and texts without a letter are `und` with score 0, as is everything
    where no row can be learned from. Null ids are held out. Rows that repeat an id each get a
    row; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(sample(rows))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        lambda it: label_rows(it, model), "doc_id long, held_out boolean, lang_pred string, score double"
    )
