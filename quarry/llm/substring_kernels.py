"""Kernels of the suffix-array operator: cutting texts at minimizers, suffix sorting by groups, and
finding the windows that occur before."""

from __future__ import annotations

import numpy as np

from quarry.llm.common import BYTE_VALUES, U64, prefix_hash, span_hash

#: Low bits of a packed key that hold a place; above them is the hash.
_PLACE = 31
_LOW = U64((1 << _PLACE) - 1)


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Cut concatenated texts into runs of windows of `length` bytes with one and the same minimizer.

    A window's minimizer is its leftmost gram of least hash, so equal windows have it at the same
    place with the same hash. Gives (document, first byte, gram's place in the piece, bytes,
    minimizer hash, piece hash); the windows of a piece are all of `length` bytes in it, and each
    window of a text is in one piece.
    """
    width = length - gram + 1
    n = len(raw)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if n >> _PLACE:
        raise ValueError("a text over 2 GB can't be cut in one slice")
    prefix = prefix_hash(BYTE_VALUES[raw])
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram)
    low = (h & ~_LOW) | at.astype(np.uint64)
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[step:], low[:-step])
        step *= 2
    if step < width:
        low = np.minimum(low[width - step :], low[: -(width - step)])
    arg = (low & _LOW).astype(np.int64)
    windows = len(arg)  # starts 0 .. n - length
    edge = np.zeros(n + 1, np.int32)
    starts, stops = offsets[:-1], offsets[1:]
    edge += np.bincount(np.maximum(stops - length + 1, starts), minlength=n + 1).astype(np.int32)
    edge -= np.bincount(stops, minlength=n + 1).astype(np.int32)
    valid = np.cumsum(edge[:windows]) == 0
    fresh = np.ones(windows, bool)
    fresh[1:] = (arg[1:] != arg[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & fresh)
    ends = np.ones(windows, bool)
    ends[:-1] = fresh[1:] | ~valid[1:]
    last = np.flatnonzero(valid & ends)
    size = last - first + length
    doc = np.searchsorted(offsets, first, side="right") - 1
    return doc, first - offsets[doc], arg[first] - first, size, h[arg[first]], span_hash(prefix, first, first + size)


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of an array of positive numbers, in linear time by grouping.

    First, suffixes are grouped by their first symbol, and groups are taken from the highest down.
    For each suffix of a group the nearest earlier suffix in a lower group is its previous smaller
    one, found along pointers already set. Those that are pointed to by more members of the group
    are larger: they leave their old group for a new one just above it. In the end a group holds
    the suffixes that share their longest Lyndon prefix. Second, from the lowest suffix up, the
    suffix before each one and its chain of previous smaller ones take the next place of their
    groups, which orders every group.
    """
    n = len(text) + 1
    symbols = np.append(text, 0)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = np.diff(np.append(first, n))
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(first, counts)
    sizes = np.zeros(n, np.int64)
    sizes[first] = counts
    listed, place, group, size = order.tolist(), inverse.tolist(), group_of.tolist(), sizes.tolist()
    smaller = [-1] * n

    top = n - 1
    while top >= 0:
        base = group[listed[top]]
        if base == top:
            p = listed[top] - 1
            i = p + 1
            while p >= 0 and group[p] >= base:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                g = group[p]
                left = size[g] - 1
                if left:
                    e = g + left
                    q, other = place[p], listed[e]
                    listed[q], place[other] = other, q
                    listed[e], place[p] = p, e
                    size[g], size[e], group[p] = left, 1, e
        else:
            votes: dict[int, int] = {}
            for i in sorted(listed[base : top + 1]):
                p = i - 1
                while p >= 0 and group[p] >= base:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    votes[p] = votes.get(p, 0) + 1
            by_votes: dict[int, list[int]] = {}
            for p, v in votes.items():
                by_votes.setdefault(v, []).append(p)
            for v in sorted(by_votes, reverse=True):
                leaving: dict[int, list[int]] = {}
                for p in by_votes[v]:
                    leaving.setdefault(group[p], []).append(p)
                for g, out in leaving.items():
                    left = size[g] - len(out)
                    if not left:
                        continue
                    e = g + size[g]
                    for p in out:
                        e -= 1
                        q, other = place[p], listed[e]
                        listed[q], place[other] = other, q
                        listed[e], place[p] = p, e
                    size[g], size[e] = left, len(out)
                    for p in out:
                        group[p] = e
        top = base - 1

    result, free, placed = [-1] * n, list(range(n)), bytearray(n)
    result[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        p = result[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            c = free[g]
            result[c], free[g], placed[p] = p, c + 1, 1
            p = smaller[p]
    return np.array(result[1:], np.int64)


def _grouped(symbols: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes by first symbol, their places, group of each suffix, sizes of groups) in each text."""
    n = len(symbols)
    order = np.argsort(owner * 260 + symbols, kind="stable")
    ranked, own = symbols[order], owner[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, n))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, counts)
    sizes = np.zeros(n, np.int64)
    sizes[first] = counts
    return order, place, group, sizes


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def sort_many(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What sort_suffixes gives for each of many short texts that stand end to end, as places in
    symbols. A step takes the highest group that is left of every text at once."""
    n_texts = len(sizes)
    stops = np.cumsum(sizes + 1)
    begins = stops - sizes - 1
    text = np.zeros(int(stops[-1]) if n_texts else 0, np.int64)
    text[_ranges(begins, sizes)] = symbols
    owner = np.repeat(np.arange(n_texts), sizes + 1)
    listed, place, group, size = _grouped(text, owner, n_texts)
    smaller = np.arange(len(text)) - 1
    smaller[begins] = -1
    leaving = np.zeros(len(text), bool)
    top = stops - 1
    low = begins
    while len(top):
        base = group[listed[top]]
        counts = top - base + 1
        members = listed[_ranges(base, counts)]
        floor = np.repeat(base, counts)
        # A member that is not settled points to the suffix before it, so chains through the same
        # group need no order; each round doubles what they skip.
        on = np.arange(len(members))
        while len(on):
            p = smaller[members[on]]
            on = on[p >= 0]
            p = p[p >= 0]
            go = group[p] >= floor[on]
            on, p = on[go], p[go]
            smaller[members[on]] = smaller[p]
        p = smaller[members]
        p, votes = np.unique(p[p >= 0], return_counts=True)
        g = group[p]
        by = np.lexsort((-votes, g))
        p, votes, g = p[by], votes[by], g[by]
        if len(p):
            head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            out = np.diff(np.append(head, len(g)))
            groups = g[head]
            whole = size[groups]
            rank = np.arange(len(g)) - np.repeat(head, out)
            goal = g + np.repeat(whole, out) - 1 - rank
            last = np.concatenate([(g[1:] != g[:-1]) | (votes[1:] != votes[:-1]), [True]])
            ends = np.flatnonzero(last)
            block = np.diff(np.concatenate([[-1], ends]))
            # What leaves goes to the end of its old group and changes places with what stood there.
            leaving[p] = True
            at = place[p]
            gap = at[at < g + np.repeat(whole - out, out)]
            displaced = listed[goal]
            displaced = displaced[~leaving[displaced]]
            leaving[p] = False
            listed[gap], place[displaced] = displaced, gap
            listed[goal], place[p] = p, goal
            size[groups] = whole - out
            size[goal[ends]] = block
            group[p] = np.repeat(goal[ends], block)
        top = base - 1
        left = top >= low
        top, low = top[left], low[left]

    result = np.full(len(text), -1, np.int64)
    free = np.arange(len(text))
    placed = np.zeros(len(text), bool)
    result[begins] = stops - 1
    placed[stops - 1] = True
    longest = np.argsort(-sizes, kind="stable")
    starts, spans = begins[longest], sizes[longest] + 1
    for i in range(int(spans[0]) if n_texts else 0):
        live = np.searchsorted(-spans, -i, side="left")
        here = starts[:live]
        p = result[here + i] - 1
        ok = p >= here
        p = p[ok]
        while len(p):
            p = p[~placed[p]]
            g = group[p]
            c = free[g]
            result[c] = p
            free[g] = c + 1
            placed[p] = True
            p = smaller[p]
            p = p[p >= 0]
    keep = np.ones(len(text), bool)
    keep[begins] = False
    result = result[keep]
    return result - np.repeat(np.arange(n_texts), sizes)


#: Symbols up to which a text is sorted together with others.
SHORT = 4096


def sort_texts(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of texts that stand end to end, as places in symbols."""
    starts = np.cumsum(sizes) - sizes
    short = sizes <= SHORT
    if short.all():
        return sort_many(symbols, sizes) if len(sizes) else np.zeros(0, np.int64)
    out = np.empty(len(symbols), np.int64)
    if short.any():
        at = _ranges(starts[short], sizes[short])
        out[at] = at[sort_many(symbols[at], sizes[short])]
    for s, n in zip(starts[~short].tolist(), sizes[~short].tolist()):
        out[s : s + n] = s + sort_suffixes(symbols[s : s + n])
    return out


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray(len(raw) - 7, np.uint64, raw.tobytes(), strides=(1,))


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the length bytes from a and from b on are the same, for each pair."""
    if length < 8:
        reach = np.arange(length)
        return (raw[a[:, None] + reach] == raw[b[:, None] + reach]).all(axis=1)
    words = _words(raw)
    same = np.ones(len(a), bool)
    for step in sorted({*range(0, length - 7, 8), length - 8}):
        on = np.flatnonzero(same)
        same[on] = words[a[on] + step] == words[b[on] + step]
    return same


def repeats_in(raw: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, from, to) of the spans whose windows occur earlier in another text of their bucket.

    Texts stand end to end in raw, those of a bucket together; (row, start) is the place of a text,
    and a place that comes twice is one text. Fingerprints leave out windows that nothing repeats; the
    suffixes of the rest are sorted bucket by bucket, windows that are neighbours in that order are
    compared byte by byte, and all but the earliest of equal windows are reported.
    """
    none = np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if len(raw) < length:
        return none, none, none
    by = np.lexsort((start, row, bucket))
    again = np.zeros(len(sizes), bool)
    again[by[1:]] = (bucket[by[1:]] == bucket[by[:-1]]) & (row[by[1:]] == row[by[:-1]]) & (start[by[1:]] == start[by[:-1]])
    windows = np.where(again, 0, np.maximum(sizes - length + 1, 0))
    at = _ranges(begins, windows)
    owner = np.repeat(np.arange(len(sizes)), windows)
    h = span_hash(prefix_hash(BYTE_VALUES[raw]), at, at + length)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at, owner = at[hit], owner[hit]
    if not len(at):
        return none, none, none
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])]))
    tail = np.append(head[1:], len(at)) - 1
    lo, span, owner = at[head], at[tail] - at[head] + length, owner[head]

    # A bucket's spans with a mark after each are one text to be sorted.
    cut = _ranges(lo, span)
    stops = np.cumsum(span + 1)
    symbols = np.ones(int(stops[-1]), np.int64)
    where = _ranges(stops - span - 1, span)
    symbols[where] = raw[cut].astype(np.int64) + 2
    origin = np.full(len(symbols), -1, np.int64)
    origin[where] = cut
    span_of = np.repeat(np.arange(len(span)), span + 1)
    own = bucket[owner]
    fresh = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    text_sizes = np.add.reduceat(span + 1, fresh)
    text_of = np.repeat(np.arange(len(text_sizes)), text_sizes)
    ranked = sort_texts(symbols, text_sizes)
    ranked = ranked[ranked + length < stops[span_of[ranked]]]
    if not len(ranked):
        return none, none, none
    text_of, span_of, origin = text_of[ranked], span_of[ranked], origin[ranked]
    pair = np.flatnonzero(text_of[1:] == text_of[:-1])
    equal = np.zeros(len(ranked), bool)
    equal[pair + 1] = _same_bytes(raw, origin[pair], origin[pair + 1], length)
    piece = owner[span_of]
    first = start[piece] + origin - begins[piece]
    # A window may stand in two texts of one row: equal places have one rank.
    by = np.lexsort((first, row[piece]))
    moved = (first[by[1:]] != first[by[:-1]]) | (row[piece[by[1:]]] != row[piece[by[:-1]]])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.concatenate([[0], np.cumsum(moved)])
    least = np.minimum.reduceat(rank, np.flatnonzero(~equal))
    later = np.sort(origin[rank != least[np.cumsum(~equal) - 1]])
    if not len(later):
        return none, none, none
    piece = np.searchsorted(ends, later, side="right")
    head = np.flatnonzero(np.concatenate([[True], (later[1:] != later[:-1] + 1) | (piece[1:] != piece[:-1])]))
    tail = np.append(head[1:], len(later)) - 1
    piece = piece[head]
    return piece, later[head] - begins[piece], later[tail] - begins[piece] + length


def repeats(texts: list[bytes], places: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """repeats_in for the texts of one bucket; places are (row, first byte). A text at the place of
    another is reported as that one is."""
    sizes = np.array([len(t) for t in texts], np.int64)
    row, start = (np.array(x, np.int64) for x in zip(*places))
    found = repeats_in(np.frombuffer(b"".join(texts), np.uint8), sizes, np.zeros(len(texts), np.int64), row, start, length)
    out = [(int(i), int(a), int(b)) for i, a, b in zip(*found)]
    first: dict[tuple[int, int], int] = {}
    twins = [(k, first[p]) for k, p in enumerate(places) if first.setdefault(p, k) != k]
    return out + [(k, a, b) for k, of in twins for i, a, b in out if i == of]
