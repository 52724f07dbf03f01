"""Operator 3: quality classifier. Neighbour voting among labelled documents in a latent space of words, letters and the text's surface."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow
from .suffix_order import word_bounds, word_hashes

CLASSES = 16
SURFACE = CLASSES**3 + 11
LETTERS, WORDS = 2048, 4096  # hashed features: three letters in a row, and words
BINS = SURFACE + LETTERS + WORDS
PER_CLASS = 2000  # labelled rows of each class that are learned from, at most
LATENT = 48
NEIGHBOURS = 25
BLOCK = 1024


def _table() -> np.ndarray:
    """A class for each byte: letters by case, digits, white space, and groups of punctuation; bytes over 127 count as small letters."""
    t = np.full(256, 15, np.uint8)
    t[128:] = 0
    for k, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\x0b\x0c", ".", ",", "!?", "|", "#%&", "*$@^~", "-_/\\", "\"'`()[]{}", ":;", "<>=+"]):
        t[list(chars.encode())] = k
    return t


CLASS_OF = _table()


def shares(bins: np.ndarray, size: int, at: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The bins that occur, from `at` on, and the roots of their shares times weight."""
    counts = np.bincount(bins, minlength=size)
    some = np.flatnonzero(counts)
    return some + at, weight * np.sqrt(counts[some] / max(len(bins), 1))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: class trigrams (runs of letters of one case count once), the share of repeated lines, trigrams of bytes and words in lower case."""
    raw = text.encode("utf-8", "replace")
    c = CLASS_OF[np.frombuffer(raw, np.uint8)]
    if len(c):
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != c[:-1]) | (c[1:] > 2)
        c = c[keep].astype(np.int32)
    parts = [shares(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], CLASSES**3, 0, 1.0)] if len(c) > 2 else []
    lines = [x for x in raw.split(b"\n") if x]
    again = 1 - len(Counter(lines)) / len(lines) if len(lines) > 1 else 0
    if again > 0:
        parts.append((np.array([CLASSES**3 + min(10, int(again * 10))]), np.array([0.5 * again])))
    low = raw.lower()
    if len(low) > 2:
        x = np.frombuffer(low, np.uint8).astype(np.uint32)
        three = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        parts.append(shares((three >> np.uint32(32 - 11)).astype(np.int64), LETTERS, SURFACE, 0.5))
    starts, ends = word_bounds(low)
    if len(starts):
        parts.append(shares((word_hashes(low, starts, ends) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 12)).astype(np.int64), WORDS, SURFACE + LETTERS, 0.5))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate([a for a, _ in parts]).astype(np.int32), np.concatenate([v for _, v in parts]).astype(np.float32)


class QualityModel:
    """Labelled vectors in the latent space, and the projection into it. An unlabelled or one-sided training set gives a constant score."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], latent: int = LATENT):
        y = np.array(labels, np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.vectors = None
        if len(y) < 2 or y.min() == y.max():
            return
        x = np.zeros((len(rows), BINS), np.float32)
        for i, (at, val) in enumerate(rows):
            x[i, at] = val
        self.weight = np.log((1 + len(rows)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        x *= self.weight
        k = min(latent, len(rows), BINS)
        q = np.linalg.qr(np.random.default_rng(7).standard_normal((BINS, k + 8)).astype(np.float32))[0]
        for _ in range(6):  # subspace iteration towards the leading right singular vectors
            q = np.linalg.qr(x.T @ (x @ q))[0]
        self.basis = np.ascontiguousarray((q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :k].astype(np.float32))
        self.vectors = _unit(x @ self.basis)
        self.y = y

    def scores(self, texts: list[str], neighbours: int = NEIGHBOURS) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(neighbours, len(self.y))
        for s in range(0, len(texts), BLOCK):
            block = np.zeros((len(texts[s : s + BLOCK]), self.basis.shape[1]), np.float32)
            for i, t in enumerate(texts[s : s + BLOCK]):
                at, val = features(t)
                block[i] = (val * self.weight[at]) @ self.basis[at]
            block = _unit(block)
            cos = block @ self.vectors.T
            near = np.argpartition(cos, -k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(float) ** 4 + 1e-9
            out[s : s + BLOCK] = (w * self.y[near]).sum(1) / w.sum(1)
            out[s : s + BLOCK][~block.any(axis=1)] = self.prior
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most per_class rows of either label outside the held-out fold, those with the smallest hash of the id.

    Both limits are top-k by hash over all labelled rows that have a document; the chosen ids number 2 * per_class at
    most, which bounds the broadcast. Of texts that share an id, the one with the smallest MD5 is taken."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = None
    for k in (0, 1):
        part = y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = F.min(F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), "text", "y")).alias("one")
    return found.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.y")


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, per_class: int = PER_CLASS) -> QualityModel:
    """Fits on a bounded sample: per_class labelled rows of either class at most. Features are computed on the executors."""

    def f(cols):
        rows = [features(x or "") for x in cols["text"]]
        return {"k": cols["k"], "y": cols["y"], "at": [a.tobytes() for a, _ in rows], "val": [v.tobytes() for _, v in rows]}

    sample = labelled_sample(docs, labels, "quality", folds, fold, per_class)
    got = map_arrow(sample.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("k"), "text", "y"), f, "k string, y int, at binary, val binary").collect()
    got.sort(key=lambda r: r.k)
    return QualityModel([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["val"], np.float32)) for r in got], [r.y for r in got])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """Per row: (doc_id, score, predicted); with keep, the rows of docs with predicted = 1, unchanged.

    Every document is compared with all labelled vectors (exact cosine products, block by block); the nearest vote by
    similarity. Null and empty texts have no features and get the labelled mean; rows are taken one by one, so repeated
    and null ids do no harm; other columns are not read (or, with keep, carried along). Without labels of both classes
    every score is the labelled mean, or 0.5 without labels.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)

    if keep:
        import pyarrow as pa

        i = docs.columns.index("text")

        def run(batches):
            from .common import pieces

            for b in batches:
                for p in pieces(b):
                    ok = bc.value.scores([x or "" for x in p.column(i).to_pylist()]) >= threshold
                    yield p.filter(pa.array(ok))

        return docs.mapInArrow(run, docs.schema)

    def f(cols):
        return {"doc_id": cols["doc_id"], "score": bc.value.scores([x or "" for x in cols["text"]]).tolist()}

    out = map_arrow(docs.select("doc_id", "text"), f, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
