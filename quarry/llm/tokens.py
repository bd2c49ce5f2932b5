"""Token ids by the tokenizers library, with the ids of what stands between spaces remembered.

A text is split at single spaces, which is far cheaper than finding pre-tokens: a space goes to the
pre-token after it, so a cut before a space changes nothing unless white space stands on both of
its sides. Texts where that may be are cut into pre-tokens instead.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import regex

from quarry.llm.common import KEPT

#: Units between spaces, and pre-tokens, that a worker remembers; frequent ones come early.
REMEMBERED = 450_000
#: New units that the library encodes as one text.
JOINED = 8192
_MARKS = frozenset(".,;:!?")
#: The character that stands for the byte of a space in byte-level vocabularies.
_SPACE = "\u0120"
#: A space before white space or at the end: the only place where splitting at spaces may be wrong.
_WIDE = re.compile("[\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def plain_spaces(text: str) -> bool:
    """Whether no space of text stands before white space or at its end."""
    if "  " in text or " \n" in text or text[-1:] == " " or " \t" in text or " \r" in text:
        return False
    return not _WIDE.search(text)


#: Fixed value: how byte-level BPE cuts a text; white space by its Unicode property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class LibraryEncoder:
    """ids of whole texts as little-endian uint32 bytes.

    The library encodes each distinct unit or pre-token; a text is the concatenation of their ids.
    Texts that hold the string of an added token go to the library whole, as do
    all texts of a tokenizer whose pre-tokenizer is not byte-level without normalizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.direct = not (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"))
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        # Other models list their vocabulary; there each unit is cut by itself.
        vocab: dict[str, int] = v if isinstance(v := spec["model"].get("vocab"), dict) else {}
        self.spaced = np.zeros(max(vocab.values(), default=0) + 2, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(_SPACE)]] = True
        self.cut = regex.compile(PRETOKEN).findall
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _lookup(self, store: dict[str, bytes], lists: list[list[str]], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each list of keys, one after the other; make gives those of new keys."""
        get = store.get
        out = [list(map(get, keys)) for keys in lists]
        holes = []
        for row, keys in zip(out, lists):
            at = -1
            for _ in range(row.count(None)):
                at = row.index(None, at + 1)
                holes.append((row, at, keys[at]))
        if holes:
            fresh = list({k for _, _, k in holes})
            found = dict(zip(fresh, make(fresh)))
            for row, at, k in holes:
                row[at] = found[k]
            if len(store) + len(found) <= self.remembered:
                store.update(found)
        return [b"".join(row) for row in out]

    def _by_library(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        return self._lookup(self.known, [self.cut(t) for t in texts], self._by_library)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the shortest way that gives what the library gives for it whole."""
        # Millions of strings and lists without cycles: the cycle collector would only walk them.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _by_units(self, units: list[str]) -> list[bytes]:
        """Ids of units with the space before them."""
        return [x for at in range(0, len(units), JOINED) for x in self._as_text(units[at : at + JOINED])]

    def _as_text(self, units: list[str]) -> list[bytes]:
        """Ids of units as one text: only a unit's first token starts with a space. Where that doesn't give
        a start for each unit, each is cut by itself."""
        text = " " + " ".join(units)
        if any(a in text for a in self.added):
            return self._one_by_one(units)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.spaced[np.minimum(ids, len(self.spaced) - 1)])
        if len(starts) != len(units) or starts[0]:
            return self._one_by_one(units)
        packed, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return [packed[a:b] for a, b in zip(bounds, bounds[1:])]

    def _one_by_one(self, units: list[str]) -> list[bytes]:
        """Ids of units with the space before them. Letters alone, or with one mark after them, need
        no pattern to be cut."""
        words = []
        for u in units:
            if u.isalpha():
                words.append([" " + u])
            elif u[-1:] in _MARKS and u[:-1].isalpha():
                words.append([" " + u[:-1], u[-1]])
            else:
                words.append(self.cut(" " + u))
        return self._lookup(self.known, words, self._by_library)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            if self.direct or any(a in t for a in self.added):
                out[i] = array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes()
            elif plain_spaces(t):
                plain.append((i, t.split(" ")))
            else:
                other.append(i)
        units = self._lookup(self.units, [p[1:] for _, p in plain], self._by_units)
        heads = self._by_words([p[0] for _, p in plain] + [texts[i] for i in other])
        for (i, _), head, tail in zip(plain, heads, units):
            out[i] = head + tail
        for i, ids in zip(other, heads[len(plain) :]):
            out[i] = ids
        return out


def encoder(path: str, remembered: int = REMEMBERED) -> LibraryEncoder:
    """The worker's encoder for a vocabulary file; tasks that encode go on with what it remembers."""
    key = "encoder:" + path
    if key not in KEPT or KEPT[key].remembered != remembered:
        KEPT[key] = LibraryEncoder(path, remembered)
    return KEPT[key]
