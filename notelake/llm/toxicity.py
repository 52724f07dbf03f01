"""Operator 9: toxicity. A noisy channel restores disguised words; weights learned from labels, for and against, score the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, held_out, map_arrow
from .prefix_bpe import Recent

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
BETWEEN = set(" .-_*~'·/,\t\n​­")
CANDIDATES = 2000  # features that get a weight: those that tell the classes apart best
ROWS = 50_000  # whose gradient a task sums, about
LEVELS = 3  # a feature counts anew for the second and the third distinct word that shows it
STRONG = 1.0  # weight from which a feature is looked for inside text without blanks
CUT = "\"'`.,;:!?()[]{}<>*#%&$|~^-_=/\\«»“”‘’…"
LETTERS = r"[^\W\d_]"
ANY_LEET, ANY_BETWEEN = f"[{re.escape(''.join(LEET))}]", f"[{re.escape(''.join(sorted(BETWEEN)))}]"
#: letters that stand alone, four or more in a row: words that were spread out
SPREAD = re.compile(r"(?<!\S)(?:[^\W_][ \t.\-_*]{1,3}|[@$!|+(€£¡][ \t.\-_*]{1,3}){3,}(?:[^\W_]|[@$!|+(€£¡])(?!\w)")
#: every sign that the lattice knows
DISGUISED = re.compile(rf"{LETTERS}.*{ANY_LEET}|{ANY_LEET}.*{LETTERS}|({LETTERS})\1\1|{LETTERS}{ANY_BETWEEN}+{LETTERS}")
TRIPLE = re.compile(rf"({LETTERS})\1\1")
APART = re.compile(f"{ANY_BETWEEN}+")
LONG = 40  # letters, of which no plain word has as many: words that stand without blanks


class CharModel:
    """Trigram model of letters in words, with add-one smoothing over lower orders."""

    def __init__(self, counts: dict[str, int]):
        self.tri: Counter = Counter()
        self.bi: Counter = Counter()
        for g, n in counts.items():
            self.tri[g] += n
            self.bi[g[:2]] += n
        self.size = len({c for g in self.tri for c in g}) + 1
        self.seen: dict[str, float] = {}

    def cost(self, two: str, c: str) -> float:
        key = two + c
        if (found := self.seen.get(key)) is None:
            p = (self.tri[key] + 0.5 / self.size) / (self.bi[two] + 0.5)
            found = self.seen[key] = -math.log(max(p, 1e-9))
        return found


def restore(word: str, model: CharModel) -> str:
    """The likeliest plain word behind a lower-case disguised one: Viterbi search through the lattice of its readings.

    A sign reads as itself or a letter it stands for, a separator as nothing, a run of one letter as one or two of it.
    Costs: the letter model's, and a fixed one for each reading that changes something.
    """
    runs: list[tuple[str, int]] = []
    for c in word:
        if runs and runs[-1][0] == c:
            runs[-1] = (c, runs[-1][1] + 1)
        else:
            runs.append((c, 1))
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # with the readings so far, the last one first
    for c, n in runs:
        readings: list[tuple[str, float]] = []
        if c in BETWEEN:
            readings.append(("", 0.1))
        else:
            for letter in (c, *LEET.get(c, "")):
                plain = letter.isalpha()
                paid = 0.0 if letter == c and plain else 0.5 if plain else 6.0
                readings.append((letter, paid + (0.3 if n > 1 else 0)))
                if n > 1:
                    readings.append((letter * 2, paid + (0.0 if n == 2 else 0.6)))
            if c in "!$|+(" and not readings[0][0].isalpha():
                readings.append(("", 3.0))
        after: dict[str, tuple[float, tuple | None]] = {}
        for two, (paid, out) in best.items():
            for text, more in readings:
                state, total = two, paid + more
                for x in text:
                    total += model.cost(state, x)
                    state = state[1] + x
                if state not in after or total < after[state][0]:
                    after[state] = (total, (out, text))
        best = after
    out, texts = min(best.items(), key=lambda x: (x[1][0] + model.cost(x[0], "$"), x[0]))[1][1], []
    while out is not None:
        out, text = out
        texts.append(text)
    return "".join(reversed(texts))


def features(word: str) -> list[str]:
    """A restored word, and its beginnings: stems show in inflected forms."""
    n = len(word)
    if n < 4:
        return [word]
    out = [word, word[:4] + "*"]
    if n > 4:
        out.append(word[:5] + "*")
        if n > 5:
            out.append(word[:6] + "*")
    return out


def segments(run: str, longest: int = 24) -> set[str]:
    """The features of every word that may stand in restored text without blanks; longest: letters of the longest one looked for."""
    out = {run[i:j] for i in range(len(run)) for j in range(i + 2, min(len(run), i + longest) + 1)}
    return out | {f"{run[i : i + n]}*" for n in (4, 5, 6) for i in range(len(run) - n + 1)}


def tokens(text: str) -> tuple[set[str], list[str]]:
    """The distinct words of a text in lower case, and the spread-out words in it."""
    low = text.lower()
    return set(low.split()), [m.group() for m in SPREAD.finditer(low)]


def disguised(word: str) -> bool:
    """Whether DISGUISED finds anything in a word; of letters between marks that are no sign there, only three of one in a row can be."""
    return bool((TRIPLE if word.strip(".,;:?\"'").isalpha() else DISGUISED).search(word))


class Restorer:
    """Restored forms of words, cached; a word without any sign of disguise is its own."""

    def __init__(self, model: CharModel):
        self.model = model
        self.seen = Recent(200_000)

    def forms(self, word: str) -> tuple[str, ...]:
        plain = word.strip(CUT)
        found = (plain,) if plain else ()
        if disguised(word):
            inner = word.strip(".,;:?\"'()[]{}<>#%&*-_=")
            more = {restore(x, self.model) for x in {inner, plain} if x and DISGUISED.search(x)}
            for x in APART.split(inner):  # words that only a sign parts
                if len(x) > 2 and x != inner:
                    more |= {x.strip(CUT), restore(x, self.model)}
            found += tuple(sorted(more - {plain, ""}))
        return found

    def spread(self, run: str) -> str:
        return restore(run, self.model)


class ToxicModel:
    """The letter model, and a logistic model: a bias, a weight for the logarithm of a text's distinct words (held within what the
    learned texts have), and weights of features for the first, the second and the third distinct word that shows them."""

    def __init__(self, chars: dict[str, int], weights: dict[str, tuple[float, ...]], bias: float, length: float = 0.0, seen: tuple[float, float] = (0.0, 50.0)):
        self.chars, self.weights, self.bias, self.length, self.seen = chars, weights, bias, length, seen
        self.strong = {g for g, w in weights.items() if w[0] >= STRONG}
        self.longest = max(map(len, self.strong), default=0)
        self.restorer: Restorer | None = None

    def __getstate__(self):
        return self.__dict__ | {"restorer": None}

    def inside(self, run: str) -> set[str]:
        """The strong features anywhere in restored text without blanks."""
        return segments(run, self.longest) & self.strong

    def hits(self, word: str) -> tuple[str, ...]:
        """The weighted features of one word."""
        cache = self.restorer.seen
        if (found := cache.get(word)) is None:
            forms = self.restorer.forms(word)
            found = {g for form in forms for g in features(form) if g in self.weights}
            for form in forms[1:]:  # restored ones
                if len(form) > LONG:
                    found |= self.inside(form)
            found = tuple(found)
            if len(word) < 64:
                cache.put(word, found)
        return found

    def score(self, text: str) -> float:
        """The chance that a text is toxic, by the features of all its words."""
        self.restorer = self.restorer or Restorer(CharModel(self.chars))
        words, runs = tokens(text)
        new, found = self.restorer.seen.new.get, Counter()
        for w in words:
            h = new(w)
            if h is None:
                h = self.hits(w)
            if h:
                found.update(h)
        for run in runs:
            found.update(self.inside(self.restorer.spread(run)))
        total = self.bias + self.length * min(max(math.log1p(len(words)), self.seen[0]), self.seen[1])
        for g, k in found.items():
            total += sum(self.weights[g][:k])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


class Shown:
    """The features that the words of texts show, cached by word; with `only`, those of them."""

    def __init__(self, chars: dict[str, int], only: frozenset[str] | None = None):
        self.chars, self.only = chars, only
        self.restorer: Restorer | None = None

    def __getstate__(self):
        return self.__dict__ | {"restorer": None}

    def by(self, word: str) -> tuple[str, ...]:
        found = {g for form in self.restorer.forms(word) for g in features(form) if self.only is None or g in self.only}
        out = tuple(found)
        if len(word) < 64:
            self.restorer.seen.put(word, out)
        return out

    def of(self, text: str) -> tuple[int, Counter]:
        """How many distinct words a text has, and by how many of them each feature is shown."""
        self.restorer = self.restorer or Restorer(CharModel(self.chars))
        words, runs = tokens(text)
        new, get, each = self.restorer.seen.new.get, self.restorer.seen.get, []
        for w in words:
            if (h := new(w)) is None and (h := get(w)) is None:
                h = self.by(w)
            if h:
                each.append(h)
        each += [[g for g in features(self.restorer.spread(x)) if self.only is None or g in self.only] for x in runs]
        return len(words), Counter(chain.from_iterable(each))


def block_loss(w: np.ndarray, flat: np.ndarray, sizes: np.ndarray, extra: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The log loss of some rows and its gradient: rows of `sizes` yes-or-no features, whose numbers stand in flat, one number, a constant."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    z = np.bincount(row, w[flat], len(sizes)) + w[-2] * extra + w[-1]
    d = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
    return float((np.logaddexp(0, z) - y * z).sum()), np.append(np.bincount(flat, d[row], len(w) - 2), [d @ extra, d.sum()])


def least_loss(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, scale: np.ndarray, penalty: float, steps: int, close: float = 2e-3) -> np.ndarray:
    """Weights of the least penalised loss (the last one is free of the penalty), by L-BFGS from w. loss gives a value and a gradient;
    scale is about the curvature in each direction. Ends where no part of the gradient exceeds `close` roots of the curvature."""
    keep = np.append(np.full(len(w) - 1, penalty), 0)
    unit = 1 / np.sqrt(scale + keep)

    def at(x):
        value, slope = loss(x * unit)
        return value + 0.5 * float(keep @ (x * unit) ** 2), (slope + keep * x * unit) * unit

    x = w / unit
    value, g = at(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() <= close:
            break
        way, ks = g.copy(), []
        for s, t in reversed(past):
            ks.append(s @ way / (s @ t))
            way -= ks[-1] * t
        if past:
            way *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, t), k in zip(past, reversed(ks), strict=True):
            way += (k - t @ way / (s @ t)) * s
        step = 1.0
        while True:
            after = x - step * way
            value_after, g_after = at(after)
            if value_after <= value - 1e-4 * step * (way @ g) or step < 1e-6:
                break
            step /= 4
        s, t = after - x, g_after - g
        if s @ t > 1e-12:
            past = [*past[-19:], (s, t)]
        x, value, g = after, value_after, g_after
    return x * unit


def logistic(rows: list[list[int]], extra: np.ndarray, y: np.ndarray, size: int, penalty: float = 0.5, steps: int = 400) -> tuple[np.ndarray, float, float]:
    """Weights of `size` yes-or-no features, of one number, and a bias, of the least penalised log loss over rows at hand."""
    flat, sizes = np.array([g for row in rows for g in row], np.int64), np.array([len(row) for row in rows])
    even = (extra - extra.mean()) / (extra.std() + 1e-9)
    w = least_loss(lambda w: block_loss(w, flat, sizes, even, y), np.zeros(size + 2), np.append(np.bincount(flat, minlength=size), [len(y)] * 2) / 4, penalty, steps)
    return unscaled(w, float(extra.mean()), float(extra.std()))


def unscaled(w: np.ndarray, mean: float, deviation: float) -> tuple[np.ndarray, float, float]:
    slope = float(w[-2]) / (deviation + 1e-9)
    return w[:-2], slope, float(w[-1]) - slope * mean


def logistic_of_table(each: DataFrame, seen: list[int], penalty: float = 0.5, steps: int = 200) -> tuple[np.ndarray, float, float, tuple[float, float]]:
    """As logistic, over all rows of a table (y, n, ids), and the least and largest number. seen: rows of each feature.

    Each step sums the gradients of all rows: a task sends one vector. The number is the logarithm of n + 1."""
    size = F.log1p("n")
    mean, deviation, lo, hi, rows, bad = each.agg(F.avg(size), F.stddev_pop(size), F.min(size), F.max(size), F.count("*"), F.sum("y")).first()
    each = each.coalesce(1 + rows // ROWS)

    def loss(w):
        def run(batches):
            value, slope = 0.0, np.zeros(len(w))
            for b in batches:
                ids = b.column(2)
                extra = (np.log1p(b.column(1).to_numpy()) - mean) / (deviation + 1e-9)
                v, g = block_loss(w, ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()), extra, b.column(0).to_numpy())
                value, slope = value + v, slope + g
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([slope.tobytes()], pa.binary())], ["value", "slope"])

        got = each.select("y", "n", "ids").mapInArrow(run, "value double, slope binary").collect()
        return sum(r.value for r in got), sum(np.frombuffer(r.slope) for r in got)

    share = bad / rows
    start = np.append(np.zeros(len(seen) + 1), math.log(share / (1 - share)))
    w = least_loss(loss, start, np.append(seen, [rows] * 2) * share * (1 - share), penalty, steps, 0.01)
    return *unscaled(w, mean, deviation), (lo, hi)


def level(g: str, k: int) -> str:
    """The name of a feature that k distinct words show; no feature holds a blank."""
    return g if k == 1 else f"{g} {k}"


def levels(found: Counter) -> list[str]:
    """A feature's names: its own, and one for each further distinct word that shows it, up to LEVELS."""
    return [level(g, k) for g, n in found.items() for k in range(1, min(n, LEVELS) + 1)]


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(text, y): every distinct text with a label outside the held-out fold, once, with its largest label.

    Of texts that share an id, the one with the smallest MD5 is taken. Texts move once, to the row that stands for their copies."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = docs.where("doc_id is not null and text is not null").where(~held_out(F.col("doc_id"), folds, fold)).select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("key"))
    first = own.groupBy("doc_id").agg(F.min("key").alias("key")).join(y, "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    return own.join(first, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("text", "y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> ToxicModel:
    """Learns from all labelled rows outside the fold, equal texts once.

    Letter trigrams of their words give the letter model (its alphabet's commonest 20,000). Features (words and their
    beginnings) are counted per text; those that tell the classes apart best, by the likelihood ratio, get weights for and against
    toxicity by penalised logistic regression over all these rows, whose gradients the executors sum."""
    known = as_table(labelled_texts(docs, labels, "toxic", folds, fold), "labelled")

    def grams(cols):
        words: Counter = Counter()
        for t in cols["text"]:
            words.update(set(t.lower().split()))
        c: Counter = Counter()
        for w, n in words.items():
            w = w.strip(CUT)
            if w.isalpha() and len(w) < 40:
                s = f"^^{w}$"
                for i in range(len(s) - 2):
                    c[s[i : i + 3]] += n
        return {"g": list(c), "n": list(c.values())}

    counted = map_arrow(known.select("text"), grams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(20_000).collect()
    chars = {r.g: r.n for r in counted}
    total = known.agg(F.sum("y").alias("bad"), F.count("*").alias("n")).first()
    if not total.bad or total.bad == total.n:
        return ToxicModel(chars, {}, math.log(((total.bad or 0) + 0.01) / (total.n - (total.bad or 0) + 1)))
    shown = Shown(chars)

    def count(cols):
        counts = [(Counter(), Counter()) for _ in range(LEVELS)]
        for t, y in zip(cols["text"], cols["y"], strict=True):
            found = shown.of(t)[1]
            for k, (n, b) in enumerate(counts):
                if k:
                    found = {g: m for g, m in found.items() if m > k}
                n.update(found.keys())
                if y:
                    b.update(found.keys())
        out: dict[str, list] = {"g": [], "n": [], "b": []}
        for k, (n, b) in enumerate(counts, 1):
            out["g"] += [level(g, k) for g in n] if k > 1 else n
            out["n"] += n.values()
            out["b"] += [b.get(g, 0) for g in n]
        return out

    bad, all_ = float(total.bad), float(total.n)
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    per = map_arrow(known, count, "g string, n long, b long", most=32 << 20).groupBy("g").agg(F.sum("b").cast("double").alias("b"), F.sum("n").cast("double").alias("n")).where("n >= 3")
    share = F.col("n") * bad / all_
    gain = part(F.col("b"), share) + part(F.col("n") - F.col("b"), F.col("n") - share) + part(bad - F.col("b"), bad - share) + part(all_ - F.col("n") - bad + F.col("b"), all_ - F.col("n") - bad + share)
    chosen = [(r.g, r.n) for r in per.withColumn("gain", gain).orderBy(F.desc("gain"), "g").limit(CANDIDATES).collect()]
    number = {g: i for i, (g, _) in enumerate(chosen)}
    few = Shown(chars, frozenset(g.partition(" ")[0] for g in number))

    def rows(cols):
        out: dict[str, list] = {"y": cols["y"], "n": [], "ids": []}
        for t in cols["text"]:
            n, found = few.of(t)
            out["n"].append(n)
            out["ids"].append([number[g] for g in levels(found) if g in number])
        return out

    each = as_table(map_arrow(known, rows, "y int, n int, ids array<int>"), "toxic-features")
    w, slope, bias, seen = logistic_of_table(each, [n for _, n in chosen])
    weights: dict[str, list[float]] = {}
    for (g, _), x in zip(chosen, w.tolist(), strict=True):
        name, _, k = g.partition(" ")
        if abs(x) > 0.01:
            weights.setdefault(name, [0.0] * LEVELS)[int(k or 1) - 1] = x
    return ToxicModel(chars, {g: tuple(x) for g, x in weights.items()}, bias, slope, seen)


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """Per row: (doc_id, score, predicted) over the whole text.

    Null and empty texts hold no feature and get the model's bias; rows are taken one by one, so repeated and null ids do
    no harm; an empty table gives an empty result; without labels of both classes there are no weights, and all scores are one rate.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def f(cols):
        return {"doc_id": cols["doc_id"], "score": [bc.value.score(x or "") for x in cols["text"]]}

    out = map_arrow(docs.select("doc_id", "text"), f, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


__all__ = ["fit_toxicity", "held_out", "restore", "score_toxicity"]
