"""Operator 1: token counts. A prefix table holds the exact count at every prefix, so that budgets need no second encoding."""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .prefix_bpe import PrefixBPE, Recent

#: The split pattern of byte-level BPE, and its byte alphabet (bytes that print stand for themselves, the others follow from 256 on).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
TWO_SPACES = regex.compile(r"\s\s")
CACHE = 250_000
_loaded: dict[str, TokenCounter] = {}


class TokenCounter:
    """Counts as the `tokenizers` library does for a byte-level BPE file, without added tokens; special strings in a text count as one token."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        rank = {m: i for i, m in enumerate(merges)}
        self.alphabet = {b: chr(b) for b in PRINTS}
        for b in range(256):
            self.alphabet.setdefault(b, chr(256 + len(self.alphabet) - len(PRINTS)))
        self.to_symbols = {b: self.alphabet[b] for b in range(256)}
        self.bpe = PrefixBPE(spec["model"]["vocab"], lambda x, y: rank.get((x, y)))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pieces = Recent(CACHE)
        self.chunks = Recent(CACHE)
        self.tables = Recent(20_000)

    def symbols(self, piece: str) -> str:
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_symbols)

    def table(self, piece: str) -> tuple[list[int], list[int]]:
        """The prefix table of one piece, over its bytes: each prefix's last token, and its exact count."""
        found = self.tables.get(piece)
        if found is None:
            found = self.bpe.table(self.symbols(piece))
            if len(piece) < 64:
                self.tables.put(piece, found)
        return found

    def of_piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            n = self.bpe.table(self.symbols(piece))[1][-1]
            if len(piece) < 64:
                self.pieces.put(piece, n)
        return n

    def covered(self, piece: str, budget: int) -> int:
        """The bytes that the first `budget` tokens of a piece cover: its table is read backwards from the end until the count fits."""
        last, count = self.table(piece)
        at, sizes = len(count) - 1, self.bpe.sizes
        while count[at] > budget:
            at -= sizes[last[at]] if last[at] >= 0 else 1
        return at

    def _chunk_counts(self, text: str) -> tuple[list[str], list[int]]:
        """Consecutive pieces of the text that are encoded on their own, with their counts."""
        parts: list[str] = []
        for i, segment in enumerate(self.specials.splititer(text) if self.specials else [text]):
            if i:
                parts.append("")  # a special string: the count below is 1
            if not segment:
                continue
            if TWO_SPACES.search(segment):
                parts += SPLIT.findall(segment)
            else:  # no two white spaces in a row: what a space starts is split alike wherever it stands
                first, *rest = segment.split(" ")
                if first:
                    parts.append(first)
                parts += [" " + x for x in rest]
        known = self.chunks
        counts = list(map(known.new.get, parts))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None and (n := known.get(p := parts[i])) is None:
                    n = sum(map(self.of_piece, SPLIT.findall(p))) if p else 1
                    if len(p) < 64:
                        known.put(p, n)
                counts[i] = n
        return parts, counts

    def count(self, text: str) -> int:
        return sum(self._chunk_counts(text)[1])

    def count_and_cut(self, text: str, limit: int) -> tuple[int, int]:
        """The count, and how many UTF-8 bytes the first `limit` tokens cover."""
        parts, counts = self._chunk_counts(text)
        total = sum(counts)
        if total <= limit:
            return total, len(text.encode("utf-8", "surrogatepass"))
        ends = list(accumulate(counts[: limit + 1]))
        k = bisect_right(ends, limit)  # part k passes the limit
        covered = sum(len(p.encode("utf-8", "surrogatepass")) if p else len(self._special_at(text, parts, j)) for j, p in enumerate(parts[:k]))
        left = limit - (ends[k - 1] if k else 0)
        for piece in SPLIT.findall(parts[k]):
            n = self.of_piece(piece)
            if n > left:
                return total, covered + self.covered(piece, left)
            covered += len(piece.encode("utf-8", "surrogatepass"))
            left -= n
        return total, covered

    def _special_at(self, text: str, parts: list[str], j: int) -> str:
        return self.specials.findall(text)[sum(not p for p in parts[:j])]

    def prefix_counts(self, text: str) -> list[int]:
        """For every prefix of the text's UTF-8 bytes: the tokens of the full encoding that it needs (a token it cuts counts as the prefix table says)."""
        out = [0]
        for i, segment in enumerate(self.specials.splititer(text) if self.specials else [text]):
            if i:
                special = self.specials.findall(text)[i - 1]
                out += [out[-1] + 1] * len(special.encode())
            for piece in SPLIT.findall(segment):
                base = out[-1]
                out += [base + n for n in self.table(piece)[1][1:]]
        return out


def counter(path: str) -> TokenCounter:
    """One per worker process: building it takes about a second."""
    if path not in _loaded:
        _loaded[path] = TokenCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: (id, n_bytes, n_tokens, over_limit, cut_bytes). No shuffle: rows are counted where they are read.

    Null text counts as empty (0 bytes, 0 tokens); the id may be null; repeated rows are counted one by one; an empty table
    gives an empty result; other columns, whatever their names, are not read. Texts of any length are read whole, in
    memory proportional to the longest one. cut_bytes: the bytes that the first `limit` tokens cover.
    """

    def f(cols):
        c = counter(path)
        texts = [x or "" for x in cols["t"]]
        both = [c.count_and_cut(x, limit) for x in texts]
        return {"i": cols["i"], "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "n_tokens": [n for n, _ in both], "cut_bytes": [b for _, b in both]}

    kind = dict(docs.dtypes)[id_col]
    out = map_arrow(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), f, f"i {kind}, n_bytes long, n_tokens long, cut_bytes long")
    return out.select(F.col("i").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_bytes")


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: (id, counts): for every prefix of the text's UTF-8 bytes, the empty one first, the tokens it needs.

    Null text counts as empty (one prefix, no tokens); rows are taken one by one, as in token_counts. With the table stored, a
    budget of k tokens is a search in counts, without the tokenizer."""

    def f(cols):
        c = counter(path)
        return {"i": cols["i"], "counts": [c.prefix_counts(x or "") for x in cols["t"]]}

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), f, f"i {kind}, counts array<int>", most=1 << 18).withColumnRenamed("i", id_col)
