"""Line-first cleaning: lines are judged by punctuation, navigation and boilerplate rules, failing
lines are removed, and documents that lose too much text with them are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BYTE_VALUES, U64, mix, prefix_hash, slices, span_hash, stream, string_buffers, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Marks that end a sentence, what may close after them, separators of menus,
# words that menus start with and phrases of boilerplate in English, French, German and Spanish
# (compared after lower-casing A-Z). What a rule needs of a language is in these two lists alone.
# Licence statements are not among them: later steps need them.
TERMINAL = ".!?:;…。！？"
CLOSING = "\"')]}”’»"
SEPARATORS = re.compile(r"[|»›→·•<>]")
MENU_WORDS = (
    "home", "menu", "login", "log in", "sign in", "sign up", "search", "next", "previous", "contact", "about", "share", "skip to",
    "accueil", "connexion", "se connecter", "rechercher", "recherche", "suivant", "précédent", "partager", "aller au contenu",
    "startseite", "anmelden", "suche", "suchen", "weiter", "zurück", "kontakt", "teilen", "zum inhalt",
    "inicio", "menú", "iniciar sesión", "buscar", "siguiente", "anterior", "contacto", "compartir", "ir al contenido",
)
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "enable javascript", "lorem ipsum", "click here",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "activer javascript", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "aktivieren sie javascript", "klicken sie hier",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "utiliza cookies", "active javascript", "haga clic aquí",
)
#: A line without a closing mark fails below so many words, or without any mark inside it.
SHORT_LINE = 10
#: Words of a menu item, and percent of its characters that removed lines may take from a document.
MENU_ITEM_WORDS = 3
MOST_LOST = 50

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INNER = re.compile(r"[.,;:!?]")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def line_fails(line: str) -> str | None:
    """The rule that a line with words fails: punctuation, navigation or boilerplate; else None."""
    bare = line.strip(" \t\n\v\f\r").translate(_UPPER)
    words = len(WORD.findall(bare))
    items = SEPARATORS.split(bare)
    if len(items) > 2 and words <= MENU_ITEM_WORDS * len(items):
        return "navigation"
    closed = bare.rstrip(CLOSING)[-1:] in TERMINAL and bool(bare.rstrip(CLOSING))
    if not closed and words <= 6 and bare.startswith(MENU_WORDS):
        return "navigation"
    if words <= 40 and any(p in bare for p in BOILERPLATE):
        return "boilerplate"
    if not closed and (words < SHORT_LINE or not _INNER.search(bare)):
        return "punctuation"
    return None


def clean_lines(text: str) -> tuple[str, int, int, int]:
    """(text without failing lines, characters of words lost, lines lost, repeated lines)."""
    kept, lost, gone, seen, repeated = [], 0, 0, {}, 0
    for line in text.split("\n"):
        if line not in seen:
            words = WORD.findall(line)
            seen[line] = (sum(map(len, words)) if words and line_fails(line) else 0, bool(words))
        elif seen[line][1]:
            repeated += 1
        chars = seen[line][0]
        if chars:
            lost, gone = lost + chars, gone + 1
        else:
            kept.append(line)
    return "\n".join(kept), lost, gone, repeated


def _repeats(words: np.ndarray, hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """For each document, the words in windows of k that its text holds twice or more."""
    mult = stream(47, k) | U64(1)
    grams = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        grams += hashes[j : j + len(grams)] * mult[j]
    mix(grams)
    out = np.zeros(len(words) - 1, np.int64)
    for d in range(len(out)):
        a, b = words[d], words[d + 1]
        if b - a <= k:
            continue
        own = grams[a : b - k + 1]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            at = order[np.append(same, False) | np.append(False, same)]
            cover = np.zeros(b - a + 1, np.int64)
            cover[at] += 1
            cover[at + k] -= 1
            out[d] = np.count_nonzero(np.cumsum(cover)[:-1])
    return out


def judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Any columns with text last -> those columns, the cleaned text, the counts and the verdict."""
    for batch in slices(batches):
        texts = batch.column("text")
        raw, offsets = string_buffers(texts)
        starts, ends, words = word_spans(raw, offsets)
        lead = np.concatenate([[0], np.cumsum(_LEAD[raw])])
        chars = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
        n_words = np.diff(words)
        word_chars = chars[words[1:]] - chars[words[:-1]]
        repeat = _repeats(words, span_hash(prefix_hash(BYTE_VALUES[raw]), starts, ends))
        cleaned = [clean_lines(t or "") for t in texts.to_pylist()]
        lost = np.array([c[1] for c in cleaned], np.int64)
        failed = (n_words < 10) | (100 * repeat > 20 * n_words)
        kept = ~failed & (100 * lost <= MOST_LOST * word_chars)
        made = {
            "n_words": n_words,
            "word_chars": word_chars,
            "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
            "n_dup_lines": np.array([c[3] for c in cleaned], np.int64),
            "n_repeat_words": repeat,
            "base_failed": failed,
            "kept": kept,
            "lost_chars": lost,
            "lost_lines": np.array([c[2] for c in cleaned], np.int64),
        }
        own = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in own] + [pa.array([c[0] for c in cleaned], pa.string())] + [pa.array(x) for x in made.values()],
            names=own + ["cleaned", *made],
        )


VERDICT = (
    "cleaned string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_chars long, lost_lines long"
)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, cleaned text, counts, base_failed, kept, what was lost.

    Whole texts are judged row by row, so order and repeats make no difference; a null text has
    no words and fails; a null id stays null; other columns are not read; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judge_rows, "doc_id long, " + VERDICT)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, their failing lines removed, with the columns of docs."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("text")
    names = [c for i, c in enumerate(inner.columns) if i != at]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema if f.name in names)
    judged = inner.select(*names, F.col(f"c{at}").alias("text")).mapInArrow(judge_rows, f"{schema}, {VERDICT}").where("kept")
    columns = []
    for i, name in enumerate(docs.columns):
        col = F.col("cleaned") if i == at else F.char_length("cleaned").cast(docs.schema[i].dataType) if name == "n_chars" else F.col(f"c{i}")
        columns.append(col.alias(name))
    return judged.select(*columns)
