"""Operator 5: SimHash near-duplicates. Fingerprints link by bit-sliced comparison inside pigeonhole buckets.

Where a similarity is asked for, fingerprints decide nothing: texts whose shingle sets agree in a band of minima (MinHash)
meet in buckets, and their whole sets are compared there."""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, map_arrow, map_groups, unused
from .components import components, id_of, name_of

BITS = 64
TILE = 4096  # members of a bucket that are compared with one another in one task, at most
BANDS, ROWS = 32, 4  # of minima: two sets of similarity s share a bucket but for a chance of (1 - s^4)^32, 5e-8 at 0.8
SKETCH_TILE = 256  # sets on either side of a comparison, at most
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `size` words (ASCII white space parts them, A-Z in lower case), repeats included; of all words where they are fewer."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    starts = [0, *ends]
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without any. As a signed 64-bit number."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(h), 65536):
        ones += np.unpackbits(h[s : s + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Plane j holds bit j of all members, 64 of them to a word."""
    words = -(-len(x) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(x)] = x
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(queries: np.ndarray, planes: np.ndarray, members: int, radius: int, words_at_once: int = 1 << 15):
    """(query, member) index arrays of all pairs that differ in at most `radius` bits.

    For each query and word of members, the planes are compared three at a time; carry-save adders keep the distances of
    64 members as vertical counters. Rows whose members all exceed the radius are abandoned.
    """
    width = planes.shape[1]
    found_q, found_m = [], []
    valid = np.zeros(width * 64, np.uint8)
    valid[:members] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    step = max(1, words_at_once // max(width, 1))
    levels = radius.bit_length()
    for s in range(0, len(queries), step):
        q = queries[s : s + step]
        rows = np.arange(len(q))
        counter = [np.zeros((len(q), width), np.uint64) for _ in range(levels)]
        over = np.repeat(~valid[None, :], len(q), 0)

        def add(x, level, counter=counter):
            for k in range(level, levels):
                carry = counter[k] & x
                counter[k] ^= x
                x = carry
            return x  # what does not fit the counter is over the radius

        for j in range(0, BITS, 3):
            xs = [planes[b][None, :] ^ (ALL * ((q[rows] >> np.uint64(b)) & np.uint64(1)))[:, None] for b in range(j, min(j + 3, BITS))]
            if len(xs) == 3:
                a, b, c = xs
                half = a ^ b
                over |= add(half ^ c, 0)
                over |= add((a & b) | (half & c), 1) if levels > 1 else (a & b) | (half & c)
            else:
                for x in xs:
                    over |= add(x, 0)
            if j % 6 == 3 or j + 3 >= BITS:
                same = ~over
                for k in range(levels - 1, -1, -1):  # counters above the radius
                    if radius >> k & 1:
                        same &= counter[k]
                    else:
                        over |= same & counter[k]
                        same &= ~counter[k]
                alive = (over != ALL).any(axis=1)
                if not alive.all():
                    rows, over = rows[alive], over[alive]
                    counter[:] = [c[alive] for c in counter]
                    if not len(rows):
                        break
        if len(rows):
            hit = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            r, m = np.nonzero(hit)
            found_q.append(rows[r] + s)
            found_m.append(m)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_m)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each of n members over the links a-b."""
    root = np.arange(n)
    if len(a):
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
    return root


def bands(radius: int, agree: int = 1) -> list[list[tuple[int, int]]]:
    """Sets of bit ranges (shift, width): of radius + agree ranges that cover all bits, every choice of `agree`.

    Two fingerprints within the radius differ in at most `radius` ranges, so they agree on all of one choice at least."""
    n = radius + agree
    cuts = [BITS * i // n for i in range(n + 1)]
    return [list(x) for x in combinations([(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], agree)]


def ranges_to_agree(n: int, radius: int) -> int:
    """How many bit ranges name a bucket, of n fingerprints: the fewest with which a bucket of random ones holds no more than a tile.

    More ranges mean more copies of each fingerprint but buckets that stay small however many there are; links are the same."""
    agree = 1
    while agree < 4 and n >> min(sum(w for _, w in x) for x in bands(radius, agree)) > TILE:
        agree += 1
    return agree


def fingerprint_links(fps: DataFrame, radius: int, agree: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints, rows of fps (fp, node), given by their nodes, that connect all that lie within the radius of one another.

    Each fingerprint goes to a bucket for each choice of bit ranges, by their value. Buckets of one are dropped. A bucket of
    more than TILE members is split into tiles by hash, and each pair of tiles is compared in a group of its own. A group
    emits at most one link for each of its members, those of a spanning forest.
    """
    agree = agree or ranges_to_agree(fps.count(), radius)
    masks = [sum(((1 << w) - 1) << s for s, w in ranges) for ranges in bands(radius, agree)]
    masks = F.array(*[F.lit(str(m - (1 << 64) if m >> 63 else m)).cast("long") for m in masks])
    keys = F.transform(masks, lambda m, i: F.struct(i.alias("band"), F.col("fp").bitwiseAND(m).alias("value")))
    each = fps.select("fp", "node", F.explode(keys).alias("k")).select("fp", "node", "k.band", "k.value")
    sizes = each.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    dealt = each.join(sizes, ["band", "value"]).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("fp", "node", "band", "value", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile")

    def compare(key, rows):
        x = np.array(rows["fp"], np.int64)
        order = np.argsort(x)
        x, tile = x[order], np.array(rows["tile"])[order]
        u = x.view(np.uint64)
        if key[2] == key[3]:
            a, b = near(u, bit_planes(u), len(u), radius)
        else:
            left, right = np.flatnonzero(tile == key[2]), np.flatnonzero(tile == key[3])
            if not len(left) or not len(right):
                return
            a, b = near(u[left], bit_planes(u[right]), len(right), radius)
            a, b = left[a], right[b]
        root = spanning(len(x), a, b)
        for i in np.flatnonzero(root != np.arange(len(x))):
            yield rows["node"][order[i]], rows["node"][order[root[i]]]

    kind = dict(fps.dtypes)["node"]
    return map_groups(dealt, ["band", "value", "lo", "hi"], compare, f"a {kind}, b {kind}")


@lru_cache(maxsize=1)
def permutations() -> np.ndarray:
    """An odd factor for each of the BANDS * ROWS orders of the hashes."""
    return np.random.default_rng(5).integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def band_keys(members: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band: of the smallest hashes of the set in ROWS orders. No keys for an empty set."""
    if not len(members):
        return []
    x = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 1024):
        np.minimum(least, (x[None, s : s + 1024] * permutations()).min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index arrays of the pairs of sets (sorted, none empty) whose Jaccard similarity reaches least, from whole sets."""
    n, m = len(left), len(right)
    sizes = np.array([len(x) for x in left])[:, None], np.array([len(x) for x in right])[None, :]
    shared = np.zeros((n, m))
    if n * m <= 64:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if min(len(x), len(y)) >= least * max(len(x), len(y)) - 1:
                    shared[i, j] = len(np.intersect1d(x, y, assume_unique=True))
    else:
        _, name = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        owner = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
        first = owner < n
        both = (np.bincount(name[first], minlength=name.max() + 1) > 0) & (np.bincount(name[~first], minlength=name.max() + 1) > 0)
        held = both[name]
        name, owner = (np.cumsum(both) - 1)[name[held]], owner[held]
        order = np.argsort(name, kind="stable")
        name, owner = name[order], owner[order]
        for s in range(0, int(both.sum()), 4096):  # a matrix of sets by shared hashes, some columns at a time
            part = slice(*np.searchsorted(name, [s, s + 4096]))
            holds = np.zeros((n + m, 4096), np.float32)
            holds[owner[part], name[part] - s] = 1
            shared += holds[:n] @ holds[n:].T
    return np.nonzero(shared / (sizes[0] + sizes[1] - shared) >= least)


def similar_links(found: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): links between the names of nodes (distinct shingle sets) of found (doc_id, node, key, bands) whose sets' similarity reaches least.

    Buckets are named by bands; of those with the same members one is compared. Large buckets are compared tile by tile,
    each pair of tiles in a group, which emits a spanning forest. Sets are made again from the texts (by their MD5, key) of the
    nodes that share a bucket.
    """
    id_type = dict(found.dtypes)["doc_id"]
    nodes = as_table(found.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.first("bands").alias("bands"), F.min("doc_id").alias("least")).select("node", "rep.*", "bands", name_of(F.col("least"), id_type, padded("node")).alias("named")), "nodes")
    each = nodes.select("node", F.explode("bands").alias("band"))
    sizes = each.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    once = sizes.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / SKETCH_TILE).cast("int").alias("tiles"))
    buckets = as_table(each.join(once, "band"), "buckets")
    wanted = nodes.select("node", F.col("doc_id").alias("rep"), "key").join(buckets.select("node").distinct(), "node", "left_semi")
    texts = docs.select("doc_id", text_key().alias("of"), "text")  # joined by id as well, so that a text's many copies do not meet
    texts = texts.join(wanted, (texts["of"] == wanted["key"]) & texts["doc_id"].eqNullSafe(wanted["rep"])).dropDuplicates(["node"]).select("node", "text")
    texts = texts.join(nodes.select("node", "named"), "node")
    sets = as_table(map_arrow(texts, lambda c: {"node": c["node"], "named": c["named"], "hashes": [np.unique(shingle_hashes(x or "", size)).tobytes() for x in c["text"]]}, "node long, named string, hashes binary"), "sets")
    dealt = buckets.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("node", "band", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile").join(sets, "node")

    def compare(key, rows):
        x, tile = np.array(rows["node"], np.int64), np.array(rows["tile"])
        order = np.argsort(x)
        x, tile = x[order], tile[order]
        left, right = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
        if not len(left) or not len(right):
            return
        members = [np.frombuffer(rows["hashes"][i], np.uint64) for i in order]
        a, b = similar_pairs([members[i] for i in left], [members[i] for i in right], least)
        root = spanning(len(x), left[a], right[b])
        for i in np.flatnonzero(root != np.arange(len(x))):
            yield rows["named"][order[i]], rows["named"][order[root[i]]]

    return map_groups(dealt, ["band", "lo", "hi"], compare, "a string, b string")


def padded(key: str):
    return F.lpad(F.hex(key), 32, "0")


def text_key():
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def simhash_duplicates(docs: DataFrame, size: int = 5, radius: int = 8, similarity: float | None = 0.8, fingerprints: bool = True) -> DataFrame:
    """Per row of docs: (doc_id, fp, component_id), with similarity also key, the text's MD5, and component, which
    tells components of one component_id apart where ids repeat; component_id is the smallest doc_id reachable over links.
    With similarity, fp decides nothing: without `fingerprints` it is neither made nor returned.

    Without `similarity`, rows link whose fingerprints differ in at most `radius` bits. With it, rows link whose shingle sets
    have that Jaccard similarity, however far their fingerprints are apart (see similar_links). Texts are read whole; null and
    empty texts have fingerprint zero and the empty set and link like any other. Rows with equal fingerprints (with similarity,
    equal sets) meet in an aggregation, so copies are never paired. Repeated rows each get their row; a null doc_id is never the
    smallest unless its component holds no other; an empty table gives an empty result; other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def prints(c):
        return {"doc_id": c["doc_id"], "fp": [fingerprint(shingle_hashes(x or "", size)) for x in c["text"]]}

    def sets(c):
        out: dict[str, list] = {"doc_id": c["doc_id"], "key": c["key"], **({"fp": []} if fingerprints else {}), "node": [], "bands": []}
        for x in c["text"]:
            h = shingle_hashes(x or "", size)
            members = np.unique(h)
            if fingerprints:
                out["fp"].append(fingerprint(h))
            out["node"].append(xxhash.xxh64_intdigest(members.tobytes()) - (1 << 63))
            out["bands"].append(band_keys(members))
        return out

    if similarity is None:
        found = as_table(map_arrow(docs.select("doc_id", "text"), prints, f"doc_id {kind}, fp long"), "fingerprints")
        key = "fp"
        links = None
    else:
        found = as_table(map_arrow(docs.select("doc_id", "text", text_key().alias("key")), sets, f"doc_id {kind}, key string, {'fp long, ' * fingerprints}node long, bands array<long>"), "fingerprints")
        key = "node"
        links = similar_links(found, docs, size, similarity)
    nodes = as_table(found.groupBy(key).agg(F.min("doc_id").alias("least")).select(key, "least", name_of(F.col("least"), kind, padded(key)).alias("named")), "nodes")
    if links is None:
        links = fingerprint_links(nodes.select("fp", F.col("named").alias("node")), radius)
    roots = components(links, "a", "b").select(F.col("node").alias("named"), "root")
    # a node without links is its own component; of ids that are all null, none is the least
    by_key = as_table(nodes.join(roots, "named", "left").select(key, F.when(F.col("root").isNotNull(), id_of("root", kind)).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "named").alias("component")), "classes")
    return found.join(by_key, key).select("doc_id", *(["fp"] if "fp" in found.columns else []), "component_id", *(["key", "component"] if key == "node" else []))


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies (see simhash_duplicates): of each group the row with the smallest doc_id stays, of equal ids the one with the smallest MD5 of its text.

    A row is told by its id and its text, so texts that share an id are judged apart, and of equal rows one stays. Rows without
    an id stay. Other columns are carried along, whatever their names."""
    (key,) = unused(docs, "key")
    found = simhash_duplicates(docs.where("doc_id is not null").select("doc_id", "text"), size=size, similarity=similarity, fingerprints=False)
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("one")).select(F.col("one.doc_id").alias("doc_id"), F.col("one.key").alias(key))
    kept = docs.where("doc_id is not null").withColumn(key, text_key()).join(first, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def hex64(x):
    return F.lower(F.lpad(F.hex(x), 16, "0"))
