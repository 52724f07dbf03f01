"""Operator 7: benchmark decontamination. Pigeonhole pieces of test items, found exactly and verified by Myers' bit-parallel distance."""

from __future__ import annotations

import re
import uuid

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow, as_table, pieces, unused

RATE = 0.08  # errors allowed per character of an item
PART = 4_000_000  # characters of test items that one scan holds; more items mean more scans
WHITE = re.compile(r"\s+")
_scanners: dict[str, Scanner] = {}


def plain(text: str) -> str:
    """Lower case, each run of white space one space."""
    return WHITE.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the smallest edit distance between pattern and any substring of text, and where the first such ends."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = ones, 0, m
    best, at = m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, i + 1
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
    return best, at


class Scanner:
    """Finds test items in texts. An item of m characters may have int(m * rate) errors, and is cut into one more piece than that."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        self.items: list[tuple[object, str, int]] = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            p = plain(text)
            if not p:
                continue
            k = int(len(p) * rate)
            cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where.setdefault(p[a:b], []).append((len(self.items), a))
            self.items.append((item_id, p, k))
        self.auto = ahocorasick.Automaton()
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        if where:
            self.auto.make_automaton()

    def scan(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, start, end, distance) of each item found, in places of the plain text, its first best match. Each place is verified once per item."""
        found: dict[int, tuple[int, int, int]] = {}
        if not len(self.auto):
            return []
        t = plain(text)
        tried: dict[int, list[int]] = {}
        for end, (size, places) in self.auto.iter(t):
            for i, offset in places:
                _, p, k = self.items[i]
                start = end + 1 - size - offset
                seen = tried.setdefault(i, [])
                if found.get(i, (0, 0, k + 1))[2] == 0 or any(s == start for s in seen[-8:]):
                    continue
                seen.append(start)
                a = max(0, start - k)
                if start >= 0 and t.startswith(p, start):
                    distance, e = 0, start + len(p) - a
                elif not k:
                    continue
                else:
                    distance, e = myers(p, t[a : start + len(p) + k])
                if distance <= k and distance < found.get(i, (0, 0, k + 1))[2]:
                    found[i] = (max(0, a + e - len(p)), a + e, distance)
        return sorted((self.items[i][0], *x) for i, x in found.items())


def item_parts(items: DataFrame, id_col: str, text_col: str):
    """The test items in parts of about PART characters each, so that what the driver and a task hold is bounded."""
    items = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // PART)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield [(r.i, r.t) for r in rows], k == n - 1


def contamination(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "item_id", text_col: str = "text", out_col: str = "matches") -> DataFrame:
    """docs with one more column: array of (item_id, start, end, distance), empty where no test item is found.

    The column is called out_col, with as many underscores after it as make the name new. Whole texts are scanned, without any
    shuffle. Null texts and items and those without letters match nothing; repeated items are found once; documents are
    taken row by row, so null or repeated ids do no harm; empty tables are fine; other columns are carried along. Test items
    of more than PART characters are scanned part by part, with a table written between two scans: a task holds one
    automaton, which it builds once, and one part's items.
    """
    from pyspark.sql.types import StructField, StructType

    item_type = dict(items.dtypes)[id_col]
    kind = f"array<struct<item_id:{item_type},start:int,end:int,distance:int>>"
    (name,) = unused(docs, out_col)
    out = docs.withColumn(name, F.array().cast(kind))
    i = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, out.schema[name].dataType)])
    target = _arrow(schema)
    for part, last in item_parts(items, id_col, text_col):
        bc, tag = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def scan(batches, bc=bc, tag=tag):
            import pyarrow as pa

            if tag not in _scanners:
                _scanners.clear()
                _scanners[tag] = Scanner(bc.value, rate)
            s = _scanners[tag]
            for b in batches:
                for p in pieces(b):
                    found = [(held or []) + [dict(zip(("item_id", "start", "end", "distance"), x, strict=True)) for x in s.scan(t or "")] for t, held in zip(p.column(i).to_pylist(), p.column(p.num_columns - 1).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*p.columns[:-1], pa.array(found, target.field(len(target) - 1).type)], schema=pa.schema([*(p.schema.field(k) for k in range(p.num_columns - 1)), target.field(len(target) - 1)]))

        out = out.mapInArrow(scan, schema)
        if not last:
            out = as_table(out, "scanned")
            bc.destroy()
    return out


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no test item, with their columns as they are."""
    found = contamination(docs, items, rate, id_col, text_col)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


__all__ = ["clean_documents", "contamination", "myers", "plain"]
