"""Byte-pair encoding by a table over prefixes: each prefix's unique last token, found without replaying merges.

Of all tokens that end a prefix (an Aho-Corasick automaton gives them), exactly one is the last token of the prefix's
encoding: the one that is compatible with the last token of what comes before it. Two tokens are compatible if no merge
ever crosses the border between them. The table gives the count at every prefix and, read backwards, the ids.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick


class PrefixBPE:
    """tokens: symbol strings that merging can make, to their ids. rank(x, y): the priority of merging two adjacent strings (lower first), or None."""

    def __init__(self, tokens: dict[str, int], rank: Callable[[str, str], float | None]):
        self.rank = rank
        self.ids: dict[str, int] = {}
        self.spine_r: dict[str, list[tuple[str, float]]] = {}
        self.spine_l: dict[str, list[tuple[str, float]]] = {}
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.ok: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        for t, i in sorted(tokens.items(), key=lambda x: len(x[0])):
            tree = self._tree(t)
            if tree is None:
                continue  # a token that merging cannot reach never stands in an encoding
            self.ids[t] = i
            self.auto.add_word(t, (len(self.names), len(t)))
            self.names.append(t)
            self.sizes.append(len(t))
            left, right, r = tree
            # the border symbols as they grow, each with the rank of the merge that ends it
            self.spine_r[t] = [*((x, d if d != INF else r) for x, d in self.spine_r.get(right, ())), (t, INF)]
            self.spine_l[t] = [*((x, d if d != INF else r) for x, d in self.spine_l.get(left, ())), (t, INF)]
        self.auto.make_automaton()

    def _tree(self, t: str) -> tuple[str, str, float] | None:
        """The last merge of t's own encoding, or None if it ends in several symbols. One symbol: no merge."""
        if len(t) == 1:
            return "", "", INF
        parts, last, rank = list(t), None, self.rank
        while len(parts) > 1:
            best, at = INF, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i], parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return None
            last = (parts[at], parts[at + 1], best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return last

    def _compatible(self, a: int, b: int) -> bool:
        """No merge crosses the border between tokens a and b."""
        xs, ys, i, j, rank = self.spine_r[self.names[a]], self.spine_l[self.names[b]], 0, 0, self.rank
        while True:
            (x, dx), (y, dy) = xs[i], ys[j]
            r = rank(x, y)
            if r is not None and r < dx and r <= dy:  # of equal ranks the leftmost goes first
                return False
            if dx == INF and dy == INF:
                return True
            if dx <= dy:
                i += 1
            else:
                j += 1

    def table(self, piece: str) -> tuple[list[int], list[int]]:
        """For each prefix of piece: its last token and its token count. A symbol that no token covers is -1, a token of its own."""
        n = len(piece)
        last, count, ok = [-1] * (n + 1), [0] * (n + 1), self.ok
        for end, (t, size) in self.auto.iter(piece):
            end += 1
            if count[end]:
                continue
            start = end - size
            if start:
                if not count[start]:
                    self._fill(count, start)
                before = last[start]
                if before >= 0:
                    key = before << 20 | t
                    fits = ok.get(key)
                    if fits is None:
                        if len(ok) > 1_000_000:
                            ok.clear()
                        fits = ok[key] = self._compatible(before, t)
                    if not fits:
                        continue
            last[end] = t
            count[end] = count[start] + 1
        if not count[n]:
            self._fill(count, n)
        return last, count

    @staticmethod
    def _fill(count: list[int], at: int) -> None:
        """Counts the symbols without a token that end at `at`."""
        k = at
        while k and not count[k]:
            k -= 1
        for j in range(k + 1, at + 1):
            count[j] = count[j - 1] + 1

    def encode(self, piece: str) -> list[int]:
        """The tokens (indexes into names), recovered backwards from the table; -1 stands for a symbol without a token."""
        last, _ = self.table(piece)
        out, at, sizes = [], len(piece), self.sizes
        while at:
            t = last[at]
            out.append(t)
            at -= sizes[t] if t >= 0 else 1
        out.reverse()
        return out


class Recent:
    """A cache of bounded size: what was not asked for during a whole generation goes."""

    def __init__(self, most: int):
        self.new: dict = {}
        self.old: dict = {}
        self.most = most

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


INF = float("inf")
