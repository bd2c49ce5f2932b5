"""Plain forms of the corpus operators, for small inputs only."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(rows, num, den):
    """rows: (id, text). id -> (set size, smallest id reachable) when den * both >= num * either."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in owners[x]:
                if j > i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def removals(rows, length):
    """rows: (id, text). id -> (bytes, removed, runs, what stays), by a set of strings seen so far."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g))
    return out
