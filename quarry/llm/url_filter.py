"""URL rules as globs in one bit-parallel Shift-And automaton.

Every glob takes some bits of a row of 64-bit words: one for its start and one for each literal
character. A step over a character shifts all patterns at once, and stars are self-loops held in a
mask. All URLs of a batch step together. The canonical URL is `.host`, a separator that no glob
character matches, the path, and an end mark; a star in a host never crosses the separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HOST_END, _END = 256, 257
_U1 = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """allow or block what host and path globs match; a host also stands for its subdomains.

    path is a prefix unless it ends in `$`. named rules are reported and come before the others.
    """

    verdict: str
    host: str
    path: str
    named: bool = False

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules asked for, and the method's own for URLs that none of them fits.
NAMED_RULES = (
    Rule("allow", "org", "/", True),
    Rule("block", "example.org", "/es/", True),
    Rule("block", "example.org", "/en/1", True),
    Rule("allow", "com", "/fr/", True),
    Rule("block", "com", "/de/", True),
)
OWN_RULES = (
    Rule("block", "*", "*/cgi-bin/"),
    Rule("block", "*", "*/wp-admin/"),
    Rule("block", "*", "*/login"),
    Rule("block", "*", "*/cart"),
    Rule("block", "*", "*.exe$"),
    Rule("block", "*", "*.zip$"),
    Rule("block", "*", "*.pdf$"),
    Rule("block", "*", "*.jpg$"),
    Rule("block", "ads.*", ""),
    Rule("block", "*doubleclick.*", ""),
    Rule("allow", "*", "/robots.txt$"),
)


class ShiftAnd:
    """All rules in one automaton over arrays of codes."""

    def __init__(self, rules: tuple[Rule, ...]):
        steps: list[tuple[list[int], set[int]]] = []
        for rule in rules:
            codes, loops = [], {0}  # any subdomain
            for c in (b"" if rule.host.startswith("*") else b".") + rule.host.encode():
                if c == ord("*"):
                    loops.add(len(codes))
                else:
                    codes.append(c)
            codes.append(_HOST_END)
            whole = rule.path.endswith("$")
            for c in rule.path.removesuffix("$").encode():
                if c == ord("*"):
                    loops.add(len(codes))
                else:
                    codes.append(c)
            if not whole:
                loops.add(len(codes))
            codes.append(_END)
            steps.append((codes, loops))
        bits = sum(len(c) + 1 for c, _ in steps)
        self.words = -(-bits // 64)
        self.take = np.zeros((258, self.words), np.uint64)
        self.stay = np.zeros((258, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.final = []
        at = 0
        for codes, loops in steps:
            self._set(self.begin, at)
            for i, c in enumerate(codes):
                self._set(self.take[c], at + i + 1)
            for i in loops:
                for c in range(256):  # bytes; neither the separator nor the end
                    self._set(self.stay[c], at + i)
            at += len(codes)
            self.final.append((at // 64, np.uint64(at % 64)))
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= _U1 << np.uint64(bit % 64)

    def run(self, urls: list[np.ndarray]) -> np.ndarray:
        """bool array (urls, rules). A url is its codes as host, separator, path; see encode."""
        sizes = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([urls[i] for i in order]) if len(urls) else np.zeros(0, np.int16)
        starts = np.concatenate([[0], np.cumsum(sizes[order])])[:-1]
        lengths = sizes[order]
        state = np.tile(self.begin, (len(urls), 1))
        for t in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # urls longer than t
            codes = flat[starts[:n] + t]
            old = state[:n]
            moved = old << _U1
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.take[codes]) | (old & self.stay[codes])
        out = np.zeros((len(urls), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] >> bit) & _U1 == _U1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path): both empty for null or without `://`."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    cut = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host, path[:cut]


def encode(host: str, path: str) -> np.ndarray:
    h, p = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
    codes = np.empty(len(h) + len(p) + 3, np.int16)
    codes[0] = ord(".")
    codes[1 : 1 + len(h)] = np.frombuffer(h, np.uint8)
    codes[1 + len(h)] = _HOST_END
    codes[2 + len(h) : -1] = np.frombuffer(p, np.uint8)
    codes[-1] = _END
    return codes


def filter_rows(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    automaton = ShiftAnd(rules)
    # Named rules first, then the longest, then blocking ones.
    rank = sorted(range(len(rules)), key=lambda k: (not rules[k].named, -len(rules[k].text), rules[k].verdict != "block", k))
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            hit = automaton.run([encode(*p) for p in parts])
            rule, verdict = [], []
            for (host, _), row in zip(parts, hit):
                won = next((rules[k] for k in rank if row[k]), None)
                rule.append(won.text if won and won.named else None)
                verdict.append(won.verdict if won else "allow" if host else "block")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = NAMED_RULES + OWN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages.

    The longest named rule that fits decides and is reported; else the longest of the method's
    own, blocking before allowing at a tie; else a URL with a host is allowed and one without is
    blocked. Null ids stay null, repeated rows each get a row, other columns are not read, and an
    empty table gives an empty result. URLs of any length are read whole.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: filter_rows(it, rules), f"page_id {kind}, host string, path string, rule string, verdict string")


def _like(rule: Rule) -> str:
    """A condition on host and path that the rule's glob means."""
    quote = lambda s: s.replace("'", "''")
    star = lambda s: quote(s).replace("*", "%")
    host = f"host LIKE '{star(rule.host)}' OR host LIKE '%{'' if rule.host.startswith('*') else '.'}{star(rule.host)}'"
    path = star(rule.path.removesuffix("$")) + ("" if rule.path.endswith("$") else "%")
    return f"({host}) AND path LIKE '{path}'"


def oracle(rules: tuple[Rule, ...] = NAMED_RULES + OWN_RULES) -> str:
    """The same answer as DuckDB SQL."""
    rank = sorted(range(len(rules)), key=lambda k: (not rules[k].named, -len(rules[k].text), rules[k].verdict != "block", k))
    named = "\n".join(f"WHEN {_like(rules[k])} THEN '{rules[k].text}'" for k in rank if rules[k].named)
    verdicts = "\n".join(f"WHEN {_like(rules[k])} THEN '{rules[k].verdict}'" for k in rank)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
)
SELECT page_id, host, path,
       CASE {named} ELSE NULL END AS rule,
       CASE {verdicts} WHEN host <> '' THEN 'allow' ELSE 'block' END AS verdict
FROM parts"""
