"""Operator 4: language-model scoring by online logistic mixing of hashed-context bit predictors.

Text (A-Z in lower case) is coded byte by byte, with an end sign, along Huffman trees of the training bytes (one for each
byte that may come before, and one for each of the commonest pairs of bytes before); each branch is a bit. For every bit, three predictors look up how often it was 0 or 1 in their contexts: the last two bytes, the last
four, and the word so far. Their logits are summed with weights chosen by how much the longer contexts have seen; the
weights follow the whole text (online gradient steps, block by block), and a stage corrects the mixed probability by what
came true at that level.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, held_out, map_arrow, pieces

END = 256
DIGITS = (18, 19, 19)  # binary digits of a slot's number in the three predictors, for up to SMALL bytes of training text
SIZES = tuple(1 << d for d in DIGITS)
SMALL = 1 << 28
PAIRS = 768  # pairs of bytes with a tree of their own
CHUNK = 1 << 14  # slots that travel together
TOGETHER = 32 << 10  # bytes of text that are turned into bits at once: they fit the processor's cache
BLOCK = 384  # bits between two steps of the weights
PADDED = 1 << 21  # bits, with padding, of the texts that go on side by side
GATES = 9
LEAST = np.float32(1 / 4096)
RATE, LEVELS, TRUST = 0.005, 24, 0.01
TOP_WORDS = 150_000  # the commonest words, whose counts every task holds; the others are joined
MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
BASE = MUL[1] | np.uint32(1)
BACK = np.uint32(pow(int(BASE), -1, 1 << 32))


class Tree:
    """Huffman code of the 257 symbols; a node for each branch, numbered from 0."""

    def __init__(self, counts: list[int]):
        heap = [(n + 1, i, i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        new = len(counts)
        while len(heap) > 1:
            (a, ka, x), (b, kb, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (new, 0), (new, 1)
            heapq.heappush(heap, (a + b, min(ka, kb), new))
            new += 1
        paths = []
        for i in range(len(counts)):
            path, x = [], i
            while x in parent:
                x, bit = parent[x]
                path.append((x - len(counts), bit))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.node = np.array([n for p in paths for n, _ in p], np.uint32)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    out = np.ones((2, n), np.uint32)
    out[:, 1:] = [[BASE], [BACK]]
    np.multiply.accumulate(out, axis=1, out=out)
    return out[0], out[1]


def contexts(s: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """A hash of each predictor's context for every symbol; texts begin at starts, and none sees the one before."""
    n = len(s)
    z = np.zeros(n + 4, np.uint32)
    z[4:] = s
    z[z == END] = 0
    back = [z[4 - k : 4 - k + n].copy() for k in (1, 2, 3, 4)]
    sizes = np.diff(starts, append=n)
    for j in range(4):
        at = starts[sizes > j] + j
        for c in back[j:]:
            c[at] = 0
    c1, c2, c3, c4 = back
    two = c2 << np.uint32(8) | c1
    four = (two | c3 << np.uint32(16) | c4 << np.uint32(24)) * MUL[0]
    # the word so far: sums of bytes times powers, from the word's beginning, turned to one power wherever the word stands
    at = np.arange(n)
    fresh = (c1 == 32) | ((c1 >= 9) & (c1 <= 13))
    fresh[starts] = True
    begin = np.maximum.accumulate(np.where(fresh, at, 0))
    power, inverse = powers(1 << n.bit_length()) if n <= 4 * TOGETHER else powers.__wrapped__(n)
    total = np.zeros(n, np.uint32)
    np.add.accumulate(((z[4:] + np.uint32(1)) * power[:n])[:-1], out=total[1:])
    word = (total - total[begin]) * inverse[begin] + (at - begin).astype(np.uint32) * MUL[2]
    return [two, four, word]


class Coder:
    """Turns texts into bits with their contexts. trees: a row of symbol counts for each tree; row: the tree of each pair of bytes before."""

    def __init__(self, trees: np.ndarray, row: np.ndarray, digits: tuple[int, ...] = DIGITS):
        self.row, self.digits = row * 257, digits
        trees = [Tree(c.tolist()) for c in trees]
        self.length = np.concatenate([t.length for t in trees])
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        # a node's number need not tell its tree: every context does
        bit = np.concatenate([t.bit for t in trees])
        self.branch = (np.concatenate([t.node for t in trees]) * MUL[2]) & ~np.uint32(1) | bit  # the lowest digit is the bit

    def bits_of(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each bit of all texts: its slot in each predictor's table, and its value; and the number of bits of each text."""
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes)
        s = np.empty(int(ends[-1]), np.int64)
        at = 0
        for t in texts:
            s[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += len(t) + 1
        s[ends - 1] = END
        hashes = contexts(s, ends - sizes)
        code = self.row[hashes[0]] + s  # the first context is the pair of bytes before
        length = self.length[code]
        sums = np.cumsum(length)
        owner = np.zeros(int(sums[-1]), np.int64)  # the symbol of each bit; np.repeat would take longer
        owner[sums[:-1]] = 1
        np.cumsum(owner, out=owner)
        offset = (self.start[code] - (sums - length)).take(owner, mode="clip")
        offset += np.arange(len(offset))
        branch = self.branch.take(offset, mode="clip")
        bit = (branch & np.uint32(1)).view(np.int32)
        branch &= ~np.uint32(1)
        slots = []
        for c, digits in zip(hashes, self.digits, strict=True):
            h = (c * MUL[0]).take(owner, mode="clip")
            h ^= branch
            h *= MUL[1]
            h >>= np.uint32(32 - digits)  # the highest digits depend on all others
            slots.append(h.view(np.int32))
        return slots, bit, np.diff(sums[ends - 1], prepend=0)


#: starting weights by what the second and third contexts have seen (never, up to eight times, more often)
START = np.array([[1.0, 0.0, 0.0], [0.6, 0.5, 0.0], [0.4, 0.7, 0.0], [0.6, 0.3, 0.3], [0.4, 0.4, 0.4], [0.3, 0.6, 0.3], [0.2, 0.2, 0.7], [0.2, 0.2, 0.7], [0.1, 0.4, 0.6]], np.float32)


class MixModel:
    """Logits and trust of every slot, from counts over all training texts."""

    def __init__(self, coder: Coder, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.coder = coder
        self.logit = []
        for (zeros, ones), place in zip(counts, (0, 2, 6), strict=True):
            n = zeros + ones
            p = np.clip((ones + 0.4) / (n + 0.8), 1e-5, 1 - 1e-5)
            logit = (np.log(p / (1 - p)) * (n > 0)).astype(np.float32).view(np.int32)
            # the four lowest digits of a logit tell what its slot has seen (never, up to eight times, more often), times its place in the gate
            self.logit.append((logit & ~15 | np.where(n > 8, 2, np.where(n > 0, 1, 0)) * place).astype(np.int32).view(np.float32))

    def bits_of(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each text and its end sign cost. Each text is one stream, from fresh weights."""
        out, held, first = np.zeros(len(texts)), [], 0
        for group in batches_of(texts):
            slots, y, sizes = self.coder.bits_of(group)
            xs = [l.take(x, mode="clip") for l, x in zip(self.logit, slots, strict=True)]
            gate = ((xs[1].view(np.int32) & 15) + (xs[2].view(np.int32) & 15) + y).astype(np.int16)
            at = 0
            for k, n in enumerate(sizes.tolist()):
                held.append((n, first + k, *(x[at : at + n] for x in xs), gate[at : at + n]))
                at += n
            first += len(group)
        held.sort(key=lambda x: -x[0])
        s = 0
        while s < len(held):
            lanes = held[s : s + max(1, PADDED // held[s][0])]
            out[[x[1] for x in lanes]] = self._mix(lanes)
            s += len(lanes)
        return out

    @staticmethod
    def _mix(lanes: list[tuple]) -> np.ndarray:
        """Bits of each lane (size, place, logits of the predictors, gate and value of the bits); lanes come longest first and go on side by side."""
        n = len(lanes)
        size = np.array([x[0] for x in lanes])
        width = -(-int(size[0]) // BLOCK) * BLOCK
        spare = 32  # rows of a power of two would share the cache's lines
        xs = [np.zeros((n, width + spare), np.float32) for _ in range(3)]
        codes = np.zeros((n, width + spare), np.int16)
        cost = np.zeros(n)
        for i, (k, _, a, b, c, code) in enumerate(lanes):
            xs[0][i, :k], xs[1][i, :k], xs[2][i, :k], codes[i, :k] = a, b, c, code
        weights = [np.tile(START[:, j], n) for j in range(3)]
        level = np.tile((1 / (1 + np.exp(-(np.arange(LEVELS) - (LEVELS - 1) / 2) * (12 / LEVELS)))).astype(np.float32), n)
        steps = np.arange(BLOCK)
        gates, lane = (np.arange(n) * GATES)[:, None], (np.arange(n) * LEVELS)[:, None]
        half, rate, trust = np.float32(0.5), np.float32(RATE), np.float32(TRUST)
        for s in range(0, width, BLOCK):
            live = int(np.searchsorted(-size, -s, "left"))
            whole = int(np.searchsorted(-size, -(s + BLOCK), "right"))
            code = codes[:live, s : s + BLOCK]
            bits = (code & 1).astype(np.float32)
            g = (code >> 1) + gates[:live]
            bx = [x[:live, s : s + BLOCK] for x in xs]
            logit = bx[0] * weights[0].take(g, mode="clip")
            for x, w in zip(bx[1:], weights[1:], strict=True):
                logit += x * w.take(g, mode="clip")
            p = 1 / (1 + np.exp(-logit))
            slot = np.clip(logit * np.float32(LEVELS / 12) + np.float32(LEVELS / 2), 0, LEVELS - 1).astype(np.int64) + lane[:live]
            known = level.take(slot, mode="clip")
            right = np.maximum(np.abs(half * (p + known) - (1 - bits)), np.float32(1e-6))
            error, wrong = rate * (bits - p), trust * (bits - known)
            if whole < live:  # lanes that end in this block
                tail = steps < (size[whole:live] - s)[:, None]
                for z in (error, wrong):
                    z[whole:] *= tail
                right[whole:][~tail] = 1
            for k in (BLOCK // 2, BLOCK // 4):  # four chances are multiplied for one logarithm
                right = right[:, :k] * right[:, k:]
            cost[:live] -= np.log(right).sum(1)
            flat = g.ravel()
            for x, w in zip(bx, weights, strict=True):
                np.add.at(w, flat, (error * x).ravel())
            np.add.at(level, slot.ravel(), wrong.ravel())
            np.clip(level, LEAST, 1 - LEAST, out=level)  # a whole block may push one level past a chance's bounds
        return cost / math.log(2)


def batches_of(texts: list[bytes]):
    """Runs of texts of about TOGETHER bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def lowered(text: bytes | None) -> bytes:
    return (text or b"").lower()


def tree_counts(common: list[tuple[bytes, int]], ends: int) -> tuple[np.ndarray, np.ndarray]:
    """About how often each symbol follows each byte, then each of the PAIRS commonest pairs of bytes, from the commonest
    words; and the row of each pair (of its last byte where it has none). Only the shape of the trees depends on it."""
    text = np.frombuffer(b" ".join([b"", *(w for w, _ in common), b""]), np.uint8).astype(np.int64)
    times = np.repeat(np.array([c for _, c in common], np.float64), np.array([len(w) + 1 for w, _ in common], np.int64))
    single = np.zeros((256, 257))
    np.add.at(single.reshape(-1), text[:-1] * 257 + text[1:], times)
    pair = text[:-2] * 256 + text[1:-1]
    inside = text[1:-1] != 32  # what follows a blank is the next word of a sorted list, not of a text
    pair, after, times = pair[inside], text[2:][inside], times[1:][inside]
    often = np.bincount(pair, times, 1 << 16)
    chosen = np.argsort(-often, kind="stable")[:PAIRS]
    chosen = chosen[often[chosen] > 0]
    row = np.tile(np.arange(256), 256)
    row[chosen] = np.arange(len(chosen)) + 256
    white = [0, *range(9, 14)]
    row.reshape(256, 256)[white] = row.reshape(256, 256)[32]
    place = np.full(1 << 16, -1)
    place[chosen] = np.arange(len(chosen))
    double = np.zeros((len(chosen), 257))
    own = place[pair] >= 0
    np.add.at(double.reshape(-1), place[pair[own]] * 257 + after[own], times[own])
    # a byte that no common word has after this pair is as likely as after its last byte, with a 32nd of the weight
    last = single[chosen % 256]
    double += last / np.maximum(last.sum(1, keepdims=True), 1) * (often[chosen] / 32)[:, None]
    starts = single[32].copy()
    single[10] += starts / 16
    single[0] += starts / 1000
    single[:, END] += ends / 64
    return np.concatenate([single, double]), row


def fit_mix(training: DataFrame, coder: Coder) -> MixModel:
    """Counts of the bits in every slot over all training texts. Each task sends its tables in chunks; chunks are summed
    as they come in, then the sums, whose size the slots fix, go to the driver."""
    import pyarrow as pa

    sizes = [1 << d for d in coder.digits]
    bounds = np.cumsum([0, *sizes])

    def count(batches):
        tables = [np.zeros((size, 2), np.uint32) for size in sizes]
        for b in batches:
            for p in pieces(b, 4 << 20):
                for group in batches_of([lowered(t) for t in p.column(0).to_pylist()]):
                    slots, y, _ = coder.bits_of(group)
                    ones, wide = np.ones(len(y), np.uint32), y.astype(np.int64)
                    for s, table in zip(slots, tables, strict=True):
                        np.add.at(table.reshape(-1), s * np.int64(2) + wide, ones)
        flat = np.concatenate([t.reshape(-1) for t in tables]).reshape(-1, CHUNK * 2)
        some = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([flat[i].tobytes() for i in some], pa.binary())], ["chunk", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), raw_type)
                if chunk in total:
                    total[chunk] += x
                else:
                    total[chunk] = x.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    raw_type = np.uint32
    sums = as_table(training.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary"), "slots")
    flat = np.zeros((int(bounds[-1]) // CHUNK, CHUNK * 2), np.int64)
    for r in sums.toLocalIterator():
        flat[r.chunk] = np.frombuffer(r.counts, np.int64)
    flat = flat.reshape(-1, 2)
    return MixModel(coder, [(flat[a:b, 0], flat[a:b, 1]) for a, b in zip(bounds, bounds[1:], strict=False)])


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts; tasks count their words first and send what they hold when it grows large."""
    import pyarrow as pa

    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for p in pieces(b):
                for t in p.column(0).to_pylist():
                    held.update(lowered(t).split())
                if len(held) > 600_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=schema)
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=schema)

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def digits_for(size: int) -> tuple[int, ...]:
    """Binary digits of the slots' numbers for so many bytes of training text: one more for each sixteenfold."""
    return tuple(d + max(0, round(math.log(max(size, 1) / SMALL, 16))) for d in DIGITS)


def score_lm(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Per row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    Trains on all rows outside the fold. base_score is the add-one unigram score, exact: the counts of the TOP_WORDS
    commonest words go to every task (a bounded table), those of all other words are joined by word, a row for each rare
    word of a document. score is the mixed model's log10 probability of the whole text and its end. Null texts are empty (one token, the end); rows
    are scored one by one, so repeated and null ids do no harm; an empty table gives an empty result; other columns are
    not read. Without training rows all counts are zero and the mixed model starts from even odds.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    training = rows.where(~F.col("held_out"))
    counts = as_table(word_counts(training), "words")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    whole = training.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ends = whole["rows"]
    n, v = (totals.n or 0) + ends, totals.v + (ends > 0)
    # words are ranked in steps of their count's logarithm, some thousand at most; whole steps are taken, from the top, as
    # long as TOP_WORDS holds them, and nothing but those words reaches the driver
    step = F.floor(F.log2("c") * 256)
    least, words = 1 << 20, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        words += r.words
        if words > TOP_WORDS:
            break
        least = r.step
    common = sorted((bytes(r.word), r.c) for r in counts.where(step >= least).collect())
    model = fit_mix(training, Coder(*tree_counts(common, ends), digits_for(whole["bytes"] or 0)))
    bc = docs.sparkSession.sparkContext.broadcast(({w: math.log10(c + 1) for w, c in common}, model))
    below = math.log10(n + v + 1)

    def f(cols):
        common, model = bc.value
        raws = [lowered(t) for t in cols["text"]]
        bits = model.bits_of(raws)
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base", "score", "size", "rare", "times")}
        for doc_id, held, raw, b in zip(cols["doc_id"], cols["held_out"], raws, bits.tolist(), strict=True):
            words = raw.split()
            logs = list(map(common.get, words))
            missing = Counter(w for w, c in zip(words, logs, strict=True) if c is None) if None in logs else {}
            total = len(words) + 1
            known = total - sum(missing.values()) - (ends == 0)
            base = math.log10(ends + 1) + math.fsum(c for c in logs if c is not None)
            for key, x in (("doc_id", doc_id), ("held_out", held), ("n_tokens", total), ("n_known", known), ("base", base - total * below), ("score", -b * math.log10(2)), ("size", len(raw)), ("rare", list(missing)), ("times", list(missing.values()) if missing else [])):
                out[key].append(x)
        return out

    first = map_arrow(rows.select("doc_id", "text", "held_out"), f, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, size long, rare array<binary>, times array<int>", most=2 << 20)
    first = as_table(first.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = first.select("row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("k"))).alias("r")).select("row", "r.word", "r.k")
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("base_more"))
    both = first.drop("rare", "times").join(found, "row", "left")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.greatest("size", F.lit(1))).alias("bits_per_byte"))


__all__ = ["Coder", "MixModel", "Tree", "score_lm"]
