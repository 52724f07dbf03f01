"""Linear-time suffix sorting by grouping: Lyndon prefixes first, then each group's order, without recursive renaming."""

from __future__ import annotations

import re

import numpy as np
import xxhash

GRAM = 32
WORD_GRAM = 8
WORD = re.compile(rb"[^ \n]*[ \n]?")
MASK = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], np.uint64)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of s, numbers from 0 whose last must be smaller than all others, in time linear in len(s) + max(s).

    Phase 1 takes the groups of suffixes in descending order. For each suffix of a group it finds the nearest one before
    it that stands in a smaller group (the pointers found earlier are followed, so no place is passed twice), and moves
    the suffixes pointed at, by how often they are, behind the others of their groups. In the end a group holds the
    suffixes with one Lyndon prefix. Phase 2 reads the order from left to right: each suffix settles the next free place
    of the groups along the chain of pointers that starts before it.
    """
    n = len(s)
    buckets: list[list[int] | None] = [None] * (max(s) + 1)
    for i, c in enumerate(s):
        if (held := buckets[c]) is None:
            buckets[c] = [i]
        else:
            held.append(i)
    order: list[int] = []
    place = [0] * n  # where a suffix stands in order
    first = [0] * n  # where its group begins
    size = [0] * n  # a group's size, by its beginning
    for held in buckets:
        if held:
            begin = len(order)
            size[begin] = len(held)
            for i, p in enumerate(held, begin):
                place[p], first[p] = i, begin
            order += held
    unknown = -2
    before = [unknown] * n
    end = n
    while end:
        begin = first[order[end - 1]]
        group = order[begin:end]
        hits: dict[int, int] = {}
        for p in group:
            if before[p] != unknown:
                continue
            open_ = [p]  # those whose pointer waits for one of the same group before them
            while open_:
                q = open_[-1]
                j = q - 1
                while j >= 0 and first[j] >= begin and before[j] != unknown:
                    j = before[j]
                if j >= 0 and first[j] >= begin:
                    open_.append(j)
                    continue
                before[q] = j
                if j >= 0:
                    hits[j] = hits.get(j, 0) + 1
                open_.pop()
        if hits:
            by_count: list[dict[int, list[int]] | None] = [None] * (max(hits.values()) + 1)
            for j, k in hits.items():
                if (groups := by_count[k]) is None:
                    groups = by_count[k] = {}
                groups.setdefault(first[j], []).append(j)
            for groups in reversed(by_count):
                for g, members in (groups or {}).items():
                    left = size[g] - len(members)
                    if not left:
                        continue
                    new = tail = g + left
                    size[g] = left
                    size[new] = len(members)
                    for j in members:
                        first[j] = new
                    # those of the tail that stay change places with those that go there
                    stay = [p for p in order[new : new + len(members)] if first[p] != new]
                    if stay:
                        free = iter(stay)
                        for j in members:
                            at = place[j]
                            if at < tail:
                                p = next(free)
                                q = place[p]
                                order[at], order[q] = p, j
                                place[p], place[j] = at, q
        end = begin
    out = [-1] * n
    settled = [False] * n
    free = list(range(n))
    out[0] = n - 1
    settled[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not settled[p]:
            g = first[p]
            out[free[g]] = p
            free[g] += 1
            settled[p] = True
            p = before[p]
    return out


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """For each place but the first: how many symbols its suffix shares with the one before."""
    n = len(s)
    rank = [0] * n
    for i, p in enumerate(order):
        rank[p] = i
    out, h = [0] * n, 0
    for p in range(n):
        r = rank[p]
        if r:
            q = order[r - 1]
            while s[p + h] == s[q + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def grams(raw: bytes, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` bytes."""
    n = len(raw)
    if n < size:
        return np.zeros(0, np.uint64)
    m = n - size + 1
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(np.uint64)[:, 0]
    if size < 8:
        words = words & np.uint64((1 << 8 * size) - 1)
    h = (words[:m] + np.uint64(seed)) * MIX[seed]
    if size > 8:
        for q in [*range(8, size - 7, 8), size - 8]:
            h ^= h >> np.uint64(29)
            h = (h + words[q : q + m]) * MIX[1 - seed]
    h ^= h >> np.uint64(32)
    h *= MIX[0]
    return h ^ h >> np.uint64(29)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; ASCII white space parts words."""
    a = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[0], ((a != 32) & ((a < 9) | (a > 13))).view(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; of words over 256 bytes by a hash of the whole."""
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * MIX[1]
    live, at = np.arange(len(size)), 0
    while len(live) and at < 256:
        left = size[live] - at
        x = eight[starts[live] + at] & MASK[np.minimum(left, 8)]
        h[live] = ((h[live] ^ h[live] >> np.uint64(29)) + x) * MIX[0]
        live, at = live[left > 8], at + 8
    for i in live.tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return h ^ h >> np.uint64(31)


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` numbers."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    m = n - size + 1
    h = np.zeros(m, np.uint64)
    for q in range(size):
        h ^= h >> np.uint64(29)
        h = (h + words[q : q + m]) * MIX[q & 1]
    h ^= h >> np.uint64(32)
    h *= MIX[0]
    return h ^ h >> np.uint64(29)


def lone_cuts(hashes: list[np.ndarray], size: int, least: int) -> list[tuple[int, int, int]]:
    """(text, start, end), in symbols, of what is left when each gram that occurs once parts its text; pieces under `least` go.

    hashes: of the grams of `size` symbols of each text. A repeated string of `least` symbols holds repeated grams only, so
    it lies in one piece whole."""
    if not hashes:
        return []
    _, back, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    often = count[back] > 1
    out, at = [], 0
    for i, h in enumerate(hashes):
        ok = often[at : at + len(h)]
        at += len(h)
        if not len(h):
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + size - 1 >= least:
                out.append((i, a, b + size - 1))
    return out


def repeated_words(texts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """For each text, the spans of bytes covered by runs of `least` words that start at two places of the texts or more. White space between words may differ."""
    bounds = [word_bounds(t) for t in texts]
    gram = min(WORD_GRAM, least)
    pieces = lone_cuts([runs_of(word_hashes(t, *b), gram) for t, b in zip(texts, bounds, strict=True)], gram, least)
    kept: dict[tuple[bytes, ...], list[int]] = {}
    for k, (i, a, b) in enumerate(pieces):
        starts, ends = bounds[i]
        kept.setdefault(tuple(texts[i][starts[a] : ends[b - 1]].split()), []).append(k)
    # of more than two equal pieces, two are enough to show that they repeat
    strings = [x for x, ks in kept.items() for _ in ks[:2]]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not strings:
        return out
    stops = len(strings)
    ids = {w: stops + 1 + i for i, w in enumerate(sorted({w for x in strings for w in x}))}
    s: list[int] = []  # 0 at the end, then a separator for each text, then words
    for k, x in enumerate(strings):
        s += [ids[w] for w in x]
        s.append(k + 1)
    s.append(0)
    order = suffix_array(s)
    lcp = [*common_prefixes(s, order), 0]
    best = [0] * len(s)
    for r, p in enumerate(order):
        best[p] = max(lcp[r], lcp[r + 1])
    at = 0
    for ks, x in zip(kept.values(), kept, strict=True):
        found = merge([(p, p + best[at + p]) for p in range(len(x)) if best[at + p] >= least])
        at += (len(x) + 1) * min(2, len(ks))
        for k in ks:
            i, a, _ = pieces[k]
            starts, ends = bounds[i]
            out[i] += [(int(starts[a + p]), int(ends[a + q - 1])) for p, q in found]
    return [merge(x) for x in out]


def repeated_spans(texts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """For each text, the spans covered by strings of `least` bytes that start at two places of the texts or more.

    A suffix array over words decides. Words end after white space, so equal strings break into words alike, but for the
    one they start in: at each word the neighbours in suffix order give the longest match from there on, and where a match
    begins inside a word, the suffixes that share enough are compared to the left. Texts with words too long for that are
    taken byte by byte.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    gram = min(GRAM, least)
    pieces = lone_cuts([grams(t, gram) for t in texts], gram, least)
    kept: dict[bytes, list[int]] = {}
    for k, (i, a, b) in enumerate(pieces):
        kept.setdefault(texts[i][a:b], []).append(k)
    bodies = list(kept)
    # of more than two equal pieces, two are enough to show that they repeat
    strings = [x for x, ks in kept.items() for _ in ks[:2]]
    owner = [j for j, ks in enumerate(kept.values()) for _ in ks[:2]]
    if not strings:
        return out
    words = [[w for w in WORD.findall(x) if w] for x in strings]
    if max(len(w) for ws in words for w in ws) > least // 3:
        words = [[x[i : i + 1] for i in range(len(x))] for x in strings]
    spans = _spans(words, least)
    found: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for j, got in zip(owner, spans, strict=True):
        found[j] += got
    for j, ks in enumerate(kept.values()):
        if found[j]:
            merged = merge(found[j])
            for k in ks:
                i, a, _ = pieces[k]
                out[i] += [(a + x, a + y) for x, y in merged]
    return [merge(x) for x in out]


def _spans(words: list[list[bytes]], least: int) -> list[list[tuple[int, int]]]:
    # words numbered in byte order, so that suffixes stand in byte order and neighbours share most
    ids = {w: len(words) + 1 + i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    s: list[int] = []  # 0 at the end, then a separator for each text, then words
    where: list[int] = []  # byte position in the joined text
    whole: list[bytes] = []
    stops = len(words)
    at = 0
    text_of: list[int] = []
    starts: list[int] = []
    ends: list[int] = []
    for k, ws in enumerate(words):
        starts.append(at)
        for w in ws:
            s.append(ids[w])
            where.append(at)
            text_of.append(k)
            at += len(w)
        whole.append(b"".join(ws))
        ends.append(at)
        s.append(k + 1)
        where.append(at)
        text_of.append(k)
    s.append(0)
    where.append(at)
    text_of.append(-1)
    joined = b"".join(whole)
    order = suffix_array(s)
    lcp = common_prefixes(s, order)
    n = len(s)
    # bytes shared with the one before in suffix order: the words, and the start of the first words that differ
    shared = [0] * (n + 1)
    for r in range(1, n):
        if not lcp[r] and s[order[r]] <= stops:
            continue
        p, q = order[r], order[r - 1]
        h = lcp[r]
        length = where[p + h] - where[p]
        u, v = s[p + h], s[q + h]
        if u > stops and v > stops:
            x, y = joined[where[p + h] : where[p + h + 1]], joined[where[q + h] : where[q + h + 1]]
            for c, d in zip(x, y, strict=False):
                if c != d:
                    break
                length += 1
        shared[r] = length
    best = [0] * n
    rank = [0] * n
    for r, p in enumerate(order):
        rank[p] = r
        best[p] = max(shared[r], shared[r + 1])
    out: list[list[tuple[int, int]]] = [[] for _ in words]
    parted = any(len(w) > 1 for ws in words for w in ws)  # a match can begin inside a word
    for p in range(n):
        if s[p] <= stops:
            continue
        k, x, b = text_of[p], where[p], best[p]
        base = starts[k]
        if b >= least:
            out[k].append((x - base, x - base + b))
        back = x - where[p - 1] if parted and x > base else 0  # the whole word: elsewhere it may be the end of a longer one
        if back and b + back >= least and best[p - 1] < b + back:
            r = rank[p]
            for step in (-1, 1):
                reach, at_r = b, r
                while True:
                    edge = at_r if step < 0 else at_r + 1
                    if not 0 < edge < n or (reach := min(reach, shared[edge])) + back < least:
                        break
                    at_r += step
                    q = order[at_r]
                    y, low = where[q], starts[text_of[q]]
                    left = 0
                    while left < back and y - left > low and joined[x - left - 1] == joined[y - left - 1]:
                        left += 1
                    if left and left + reach >= least:
                        out[k].append((x - left - base, x - base + reach))
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
