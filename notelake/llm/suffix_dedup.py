"""Operator 10: suffix-array dedup. What a string of `length` symbols covers that starts anywhere else as well goes.

Symbols are bytes, or words. A window of `length` symbols is filed under the smallest hash of its grams, so equal windows are
filed alike. A run of windows filed under one hash is a region of a text: each window lies in exactly one. Only hashes that
occur at two places can hold repeats. The regions of one hash meet in a task, and a suffix array (suffix_order) decides
there. Groups of more bytes than a task should take are split by more hashes of the windows' ends, and windows of what is
still larger are compared by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, map_arrow, map_groups, pieces, unused
from .suffix_order import GRAM, WORD_GRAM, grams, merge, repeated_spans, repeated_words, runs_of, word_bounds, word_hashes

GROUP = 192 << 10  # bytes of regions of one hash that one task sorts, at most
RUN = 8192  # windows of one region, at most: longer runs are cut, between windows
BLOCK = 1 << 18  # symbols of a text that are hashed at once
ENDS = 96, 12  # symbols at either end of a window that name the finer groups: bytes, words
FINE = 16, 3  # symbols of a gram there
SPANS = "array<struct<a:int,b:int>>"


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, from running minima to both sides of block borders."""
    if width == 1:
        return h
    n = len(h)
    x = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    x[:n] = h
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def blocks(raw: bytes, length: int, words: bool) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(place, bytes, starts, ends of the symbols) of parts of a text; each window of `length` symbols lies in exactly one."""
    starts, ends = word_bounds(raw) if words else (None, None)
    n = (len(starts) if words else len(raw)) - length + 1
    for s in range(0, n, BLOCK):
        e = min(n, s + BLOCK) + length - 1
        if words:
            at = int(starts[s])
            yield at, raw[at : int(ends[e - 1])], starts[s:e] - at, ends[s:e] - at
        else:
            yield s, raw[s:e], np.arange(e - s), np.arange(1, e - s + 1)


def hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int, words: bool) -> np.ndarray:
    """A 64-bit hash of each gram of `size` symbols."""
    return runs_of(word_hashes(raw, starts, ends), size) if words else grams(raw, size)


def runs(names: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(name as signed, first byte, bytes, first window, end of the windows) of each run of windows with one name, RUN at most."""
    cut = np.union1d(np.flatnonzero(names[1:] != names[:-1]) + 1, np.arange(0, len(names), RUN))
    till = np.append(cut[1:], len(names))
    yield from zip(names[cut].view(np.int64).tolist(), starts[cut].tolist(), (ends[till + length - 2] - starts[cut]).tolist(), cut.tolist(), till.tolist(), strict=True)


def regions(raw: bytes, length: int, words: bool = False) -> list[tuple[int, int, int, bool]]:
    """(hash as signed, first byte, bytes, whether the hash occurs twice in it) of each region."""
    size = min(WORD_GRAM if words else GRAM, length)
    out = []
    for at, part, starts, ends in blocks(raw, length, words):
        h = hashes(part, starts, ends, size, words)
        least = sliding_min(h, length - size + 1)
        for name, s, n, a, b in runs(least, starts, ends, length):
            own = h[a : b + length - size] == least[a]
            out.append((name, at + s, n, bool(np.count_nonzero(own) > 1)))
    return out


def finer(raw: bytes, length: int, words: bool = False) -> list[tuple[int, int, int]]:
    """(hash, first byte, bytes) of the sub-regions whose windows agree in the smallest hashes of their first and last symbols."""
    size = min(FINE[words], length)
    width = max(min(ENDS[words], length), size)
    out = []
    for at, part, starts, ends in blocks(raw, length, words):
        least = sliding_min(hashes(part, starts, ends, size, words), width - size + 1)
        n = len(starts) - length + 1
        name = least[:n] * np.uint64(0x9E3779B97F4A7C15) ^ least[length - width : length - width + n]
        out += [(k, at + s, m) for k, s, m, _, _ in runs(name, starts, ends, length)]
    return out


def window_hashes(raw: bytes, length: int, words: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(half, other half of a 128-bit hash, first byte, bytes) of the windows, part by part."""
    for at, part, starts, ends in blocks(raw, length, words):
        if words:
            each = [xxhash.xxh3_128_digest(w) for w in part.split()]
            both = np.frombuffer(b"".join(each), np.uint64).reshape(-1, 2)
            one, two = (runs_of(np.ascontiguousarray(both[:, i]), length) for i in (0, 1))
        else:
            one, two = grams(part, length), grams(part, length, 1)
        n = len(one)
        yield one.view(np.int64), two.view(np.int64), at + starts[:n], ends[length - 1 : length - 1 + n] - starts[:n]


def _sorted_group(length: int, words: bool):
    """For a group of rows (key, start, body, twice): (key, start, end) of repeated spans. Equal bodies are sorted once, as two copies."""
    repeated = repeated_words if words else repeated_spans

    def f(_, rows):
        places: dict[bytes, set] = {}
        twice: set[bytes] = set()
        for key, start, body, two in zip(rows["key"], rows["start"], rows["body"], rows["twice"], strict=True):
            places.setdefault(body, set()).add((key, start))
            if two:
                twice.add(body)
        several = [len(at) > 1 or b in twice for b, at in places.items()]
        spans = iter(repeated([b for b, two in zip(places, several, strict=True) for _ in range(1 + two)], length))
        for at, two in zip(places.values(), several, strict=True):
            got = next(spans)
            if two:
                next(spans)
            for key, start in at:
                for x, y in got:
                    yield key, start + x, start + y

    return f


def _large_groups(rows: DataFrame, length: int, words: bool) -> DataFrame:
    """(key, spans), a row for each of rows (h, key, start, body) that holds repeated spans; the groups are too large for a task.

    Groups stay apart at every step, and a window lies in one region of one group and in one finer region of that. Equal
    bodies meet in an aggregation. The rest falls into finer groups, of which those of up to GROUP bytes are sorted as usual;
    windows of larger ones are compared by a 128-bit hash, of which each task sends a window once."""
    rows = rows.withColumn("c", F.md5("body"))
    place = F.struct("key", "start")
    bodies = as_table(rows.groupBy("h", "c").agg(F.first("body").alias("body"), (F.min(place) != F.max(place)).alias("twice")), "bodies")

    def split(cols):
        out: dict[str, list] = {"h": [], "g": [], "key": [], "start": [], "body": [], "twice": []}
        for h, c, body, twice in zip(cols["h"], cols["c"], cols["body"], cols["twice"], strict=True):
            for g, s, n in finer(body, length, words):
                for k, v in (("h", h), ("g", g), ("key", c), ("start", s), ("body", body[s : s + n]), ("twice", twice)):
                    out[k].append(v)
        return out

    sub = map_arrow(bodies, split, "h long, g long, key string, start int, body binary, twice boolean", most=1 << 18).withColumn("c2", F.md5("body"))
    sub = as_table(sub, "finer")
    name = F.concat_ws("|", F.col("h").cast("string"), F.col("g").cast("string"), "c2")
    small = as_table(sub.groupBy("h", "g", "c2").agg(F.first("body").alias("body"), (F.max("twice") | (F.min(place) != F.max(place))).alias("twice")), "finer-bodies")
    sizes = small.groupBy("h", "g").agg(F.sum(F.octet_length("body")).alias("n"))
    small = small.join(sizes, ["h", "g"]).withColumn("key", name)
    few = small.where(F.col("n") <= GROUP).select("h", "g", "key", F.lit(0).alias("start"), "body", "twice")
    spans = map_groups(few, ["h", "g"], _sorted_group(length, words), "key string, a int, b int")

    def windows(batches):
        names = ["h", "g", "key", "twice", "w1", "w2", "a", "b"]
        for b in batches:
            for i in range(b.num_rows):
                h, g, key, body, twice = (c[i].as_py() for c in b.columns)
                for one, two, start, size in window_hashes(body, length, words):
                    n = len(one)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, g)), pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([key])).dictionary_decode(), pa.array(np.full(n, twice, bool)), pa.array(one), pa.array(two), pa.array(start.astype(np.int32)), pa.array((start + size).astype(np.int32))], names)

    each = small.where(F.col("n") > GROUP).select("h", "g", "key", "body", "twice").mapInArrow(windows, "h long, g long, key string, twice boolean, w1 long, w2 long, a int, b int")
    at = F.struct("key", "a")
    again = each.groupBy("h", "g", "w1", "w2").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.max("twice").alias("twice")).where("twice or lo <> hi").select("h", "g", "w1", "w2")
    spans = spans.unionByName(each.join(again, ["h", "g", "w1", "w2"], "left_semi").select("key", "a", "b"))
    # from finer bodies to the places in the bodies, and from those to the places in the texts: merged spans move as arrays, a row for each place
    merged = map_arrow(spans.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")), _joined("key"), f"key string, spans {SPANS}")
    per = sub.select("h", F.col("key").alias("c"), "start", name.alias("key")).join(merged, "key").select("h", "c", _moved("spans", "start"))
    whole = map_arrow(per.groupBy("h", "c").agg(F.flatten(F.collect_list("spans")).alias("spans")), _joined("h", "c"), f"h long, c string, spans {SPANS}")
    return rows.select("h", "key", "start", "c").join(whole, ["h", "c"]).select("key", _moved("spans", "start"))


def _joined(*names: str):
    """For map_arrow: the columns named, and spans merged."""

    def f(cols):
        spans = [merge([(x["a"], x["b"]) for x in xs]) for xs in cols["spans"]]
        return {n: cols[n] for n in names} | {"spans": [[{"a": a, "b": b} for a, b in xs] for xs in spans]}

    return f


def _moved(spans: str, by: str):
    """An array of spans, each moved by a number."""
    return F.transform(spans, lambda s: F.struct((s["a"] + F.col(by)).alias("a"), (s["b"] + F.col(by)).alias("b"))).alias(spans)


def repeated_text(docs: DataFrame, length: int = 400, words: bool = False) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names, which docs does not have: whether the whole text goes, and the array of byte spans (a, b) that go.

    Equal texts are told by their MD5 and counted: a text with copies that has `length` symbols goes whole and is searched
    once for the others. Null text is empty; texts shorter than `length` keep all; null and repeated ids do no harm, since
    texts, not ids, name the places; an empty table is fine; other columns are carried along.
    """
    key, whole, spans = unused(docs, "key", "whole", "spans")
    long_enough = F.octet_length("text") >= length  # words have a byte each at least
    shorter = docs.where(~F.coalesce(long_enough, F.lit(False)))
    keyed = docs.where(long_enough).withColumn(key, F.unhex(F.md5(F.col("text").cast("binary"))))
    own = keyed.select(F.col(key).alias("key"), F.col("doc_id").alias("rep"), "text")
    copies = own.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))

    def run(batches):
        seen: set[bytes] = set()
        schema = pa.schema([("h", pa.int64()), ("key", pa.binary()), ("start", pa.int32()), ("len", pa.int32()), ("twice", pa.bool_())])
        for b in batches:
            for p in pieces(b, 1 << 20):
                out: list[tuple] = []
                for key, t in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
                    if key in seen:
                        continue  # a copy in the same task
                    if len(seen) < 100_000:
                        seen.add(key)
                    raw = t.encode("utf-8", "replace")
                    out += [(h, key, s, n, two) for h, s, n, two in regions(raw, length, words)]
                cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, schema, strict=True)], schema=schema)

    named = as_table(own.select("key", "text").mapInArrow(run, "h long, key binary, start int, len int, twice boolean"), "regions")
    place = F.struct("key", "start")
    often = named.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("twice").alias("twice")).where("twice or lo <> hi").select("h")
    few = as_table(named.join(often, "h", "left_semi").groupBy("h", "key", "start").agg(F.max("len").alias("len")), "candidates")
    large = few.groupBy("h").agg(F.sum("len").alias("n")).where(F.col("n") > GROUP).select("h", F.lit(True).alias("large"))
    marked = few.join(large, "h", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    wanted = marked.groupBy("key").agg(F.collect_list(F.struct("h", "start", "len", "large")).alias("wanted"))
    wanted = wanted.join(copies.select("key", "rep"), "key")
    found = own.join(wanted, (own["key"] == wanted["key"]) & own["rep"].eqNullSafe(wanted["rep"])).select(own["key"], "text", "wanted")

    def bodies(cols):
        out: dict[str, list] = {"h": [], "key": [], "start": [], "body": [], "large": []}
        for key, t, wanted in zip(cols["key"], cols["text"], cols["wanted"], strict=True):
            raw = t.encode("utf-8", "replace")
            for w in wanted:
                for k, v in (("h", w["h"]), ("key", key), ("start", w["start"]), ("body", raw[w["start"] : w["start"] + w["len"]]), ("large", w["large"])):
                    out[k].append(v)
        return out

    cut = as_table(map_arrow(found, bodies, "h long, key binary, start int, body binary, large boolean", most=1 << 19), "bodies")  # bodies overlap: many times the text
    small = cut.where("not large").select("h", "key", "start", "body", F.lit(False).alias("twice"))
    per_place = map_groups(small, ["h"], _sorted_group(length, words), "key binary, a int, b int")
    per_place = per_place.select("key", F.array(F.struct("a", "b")).alias("spans")).unionByName(_large_groups(cut.where("large").select("h", "key", "start", "body"), length, words))
    per = as_table(map_arrow(per_place.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), _joined("key"), f"key binary, spans {SPANS}"), "spans")
    # one row for each text that loses anything; in words, a copied text goes whole if it has enough of them
    enough = named.select("key").distinct() if words else None
    twins = copies.where("n > 1").select("key")
    twins = twins.join(enough, "key", "left_semi") if words else twins
    marks = twins.select("key", F.lit(True).alias("w")).join(per, "key", "full").select(F.col("key").alias(key), F.col("w").alias(whole), F.col("spans").alias(spans))
    out = keyed.join(marks, key, "left").drop(key)
    for name, kind in ((whole, "boolean"), (spans, SPANS)):
        shorter = shorter.withColumn(name, F.lit(None).cast(kind))
    return out.unionByName(shorter).withColumn(whole, F.coalesce(whole, F.lit(False))), whole, spans


def cut_digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) over bytes; see repeated_text for what goes and for odd inputs."""

    def f(cols):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for doc_id, t, whole, spans in zip(*(cols[k] for k in ("doc_id", "text", "whole", "spans")), strict=True):
            raw = (t or "").encode("utf-8", "replace")
            gone = [(0, len(raw))] if whole else [(x["a"], x["b"]) for x in spans or ()]
            for k, v in (("doc_id", doc_id), ("n_bytes", len(raw)), ("n_removed", sum(b - a for a, b in gone)), ("n_spans", len(gone)), ("kept_sha256", hashlib.sha256(keep(raw, gone)).hexdigest())):
                out[k].append(v)
        return out

    marked = repeated_text(docs.select("doc_id", "text"), length)[0]
    return map_arrow(marked, f, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", most=1 << 20)


def keep(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The bytes that no span covers."""
    if not gone:
        return raw
    out, at = [], 0
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def cut_repeats(docs: DataFrame, length: int = 400, words: bool = False) -> DataFrame:
    """docs with repeated strings of `length` bytes (words, if asked) taken out of text, and n_chars, where there is one, set anew.

    Characters cut in two go whole; null texts stay null; all other columns stay as they are, whatever their names."""

    @F.pandas_udf("string")
    def cut(texts, whole, spans):
        import pandas as pd

        out = []
        for t, w, s in zip(texts, whole, spans, strict=True):
            if t is None or not (w or (s is not None and len(s))):
                out.append(t)
                continue
            raw = t.encode("utf-8", "replace")
            out.append(keep(raw, [(0, len(raw))] if w else [(x["a"], x["b"]) for x in s]).decode("utf-8", "ignore"))
        return pd.Series(out)

    marked, whole, spans = repeated_text(docs, length, words)
    touched = F.col(whole) | (F.size(F.coalesce(spans, F.array().cast(SPANS))) > 0)
    new = F.when(touched, cut("text", whole, spans)).otherwise(F.col("text"))
    out = marked.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
