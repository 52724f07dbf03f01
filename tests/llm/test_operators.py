"""The operators against brute force, libraries and round trips on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from notelake.llm import decontamination, embedding_dedup, lm_scoring, piece_codec, quality, simhash, suffix_dedup, token_counts, toxicity, warc
from notelake.llm.components import components
from notelake.llm.queries import QUERIES, tokenizer_file
from notelake.llm.suffix_order import merge, repeated_spans, repeated_words, suffix_array

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, i string, key string, n long, _key string, score double"


def odd_rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "é", "ß"]) for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(r.choice([1, 5, 60, 200]))) for _ in range(30)]
    texts += [texts[2], texts[3], texts[3], texts[3] + " more", "", "", " \n\t ", "x", "a" * 1500, "ab " * 400, None, None, "Ünï 🙂 \x00 <|endoftext|> ▁", "long " + "w" * 3000]
    rows = [(i, t, "a", None, i, "k", 0.5) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0], None, None, None, None, None), (7, texts[7], "a", None, 7, "k", 0.5), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t, *_ in odd_rows()), key=str)
    out = token_counts.token_counts(docs, path, 20)
    assert got(out.drop("cut_bytes")) == want
    assert got(token_counts.token_counts(empty, path)) == []
    tables = {r.doc_id: r.counts for r in token_counts.prefix_tables(docs.where("doc_id < 10"), path).collect()}
    assert all(x[-1] == len(lib.encode(rows_[1] or "", add_special_tokens=False).ids) for rows_ in odd_rows()[:7] for x in [tables[rows_[0]]])
    c = token_counts.counter(path)
    r = random.Random(3)
    for _ in range(300):
        text = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz1é") for _ in range(r.randint(1, 14))) for _ in range(6))
        whole = lib.encode(text, add_special_tokens=False)
        for limit in (1, 3, 7):
            total, cut = c.count_and_cut(text, limit)
            assert total == len(whole.ids) and cut == (len(text.encode()) if total <= limit else sum(c.bpe.sizes[c.bpe.names.index(lib.id_to_token(i))] for i in whole.ids[:limit]))
    for text in ("hello there, world", "don't  stop"):
        counts = c.prefix_counts(text)
        assert len(counts) == len(text.encode()) + 1 and counts[-1] == len(lib.encode(text, add_special_tokens=False).ids)
    ids = lib.encode("some words that go on and on", add_special_tokens=False)
    assert c.count_and_cut("some words that go on and on", 3) == (len(ids.ids), ids.offsets[2][1])


def test_piece_codec_equals_the_library(docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((i, len(ids := lib.encode(t or "")), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t, *_ in odd_rows()), key=str)
    assert got(piece_codec.piece_digests(docs, path)) == want
    assert got(piece_codec.piece_digests(empty, path)) == []
    back = piece_codec.decode_column(piece_codec.encode_column(docs, path).drop("text"), path).select("doc_id", "text").collect()
    assert sorted(r.text for r in back) == sorted((t or "").replace("▁", " ") for _, t, *_ in odd_rows())  # the mark decodes to a space, as in the library
    c, r = piece_codec.codec(path), random.Random(1)
    for _ in range(2000):
        x = "".join(r.choice(["a", "the", " ", "\n", "▁", "é", "🙂", "ing", "  ", "1"]) for _ in range(r.randint(0, 12)))
        assert c.encode(x) == lib.encode(x) and c.decode(lib.encode(x)) == lib.decode(lib.encode(x))


def held_accuracy(spark, name, label):
    out = QUERIES[name](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    return sum(r.predicted == r[label] for r in out) / len(out)


def test_quality(spark, docs, empty):
    assert held_accuracy(spark, "op3_quality", "quality") > 0.9
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    out = quality.score_quality(docs, model)
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0
    kept = quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0)), keep=True)
    assert got(kept) == got(docs)


def test_quality_votes_as_plain_cosines_do(docs):
    """Scores against a plain loop over all labelled vectors; meaning counts, not looks alone: the words decide between texts of one shape."""
    r = random.Random(31)
    good, bad = ([f"{a}{b}" for a in x for b in ("ro", "ta", "lin")] for x in (("mel", "kor", "vin"), ("zug", "xaq", "pfu")))
    texts = [" ".join(r.choice((bad, good)[k % 2]) for _ in range(40)) for k in range(80)]
    model = quality.QualityModel([quality.features(t) for t in texts], [k % 2 for k in range(80)])
    new = [" ".join(r.choice((bad, good)[k % 2]) for _ in range(30)) for k in range(20)] + ["", "word " * 50_000]
    got_ = model.scores(new, 7)
    for t, s in zip(new, got_, strict=True):
        at, val = quality.features(t)
        x = np.zeros(quality.BINS)
        x[at] = val
        x = (x * model.weight) @ model.basis.astype(float)
        if not x.any():
            assert s == pytest.approx(0.5)
            continue
        cos = sorted(((float(x @ v) / float(np.linalg.norm(x)), y) for v, y in zip(model.vectors, model.y, strict=True)), reverse=True)[:7]
        w = [max(c, 0) ** 4 + 1e-9 for c, _ in cos]
        assert s == pytest.approx(sum(a * y for a, (_, y) in zip(w, cos, strict=True)) / sum(w), abs=2e-3)
    assert all((s > 0.5) == (k % 2 == 1) for k, s in enumerate(got_[:20]))


def test_toxicity(spark, docs, empty):
    assert held_accuracy(spark, "op9_toxicity", "toxic") > 0.9
    r = random.Random(17)
    plain = "what a fine day it is and we went there with the others so that all of them could see how good the house was in the end".split()
    rude = ["idiot", "stupid", "moron", "loser"]
    rows = [(k, " ".join(x), int(k % 3 == 0)) for k in range(600) for x in [[*r.choices(plain, k=12), *([r.choice(rude)] if k % 3 == 0 else [])]] if not r.shuffle(x)]
    base = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(base.select("doc_id", "text"), base.select("doc_id", "toxic"))
    for bad in ("you 1d10t there", "an i d i o t he", "so stuuupid", "what a m.o.r.o.n", "LOSER"):
        assert model.score(bad) > 0.5, bad
    for fine in ("a fine day", "", "it is 10:30 on 3rd street", "the and of thon"):
        assert model.score(fine) < 0.3, fine
    assert toxicity.score_toxicity(docs, model).count() == docs.count()
    none = toxicity.fit_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(empty, none).count() == 0 and toxicity.score_toxicity(docs, none).where("predicted = 1").count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """Words that few of many labelled rows hold get their weight; the bias fits the labels of all rows, not of some."""
    r = random.Random(29)
    plain = "what a fine day it is and we went there with the others so that all of them could see how good the house was in the end".split()
    rare = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(50)]
    free = [k for k in range(9000) if zlib.crc32(str(k).encode()) % 4 != 2]
    holds = {k: rare[i % 50] for i, k in enumerate(x for x in r.sample(free, 6000) if x < 7500) if i < 150}
    rows = [(k, " ".join([*r.sample(plain, 10), *([holds[k]] if k in holds else [])]), int(k < 7500 and (k in holds or k % 5 > 0))) for k in range(9000)]
    rows.append((9000, "c#b a#2 c#b", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert all(sum(model.weights[w]) > 0.1 for w in rare)
    for w in ("".join(r.choices("aabßé.,'!?1$-_:(\u200b", k=r.randint(1, 7))) for _ in range(20_000)):
        assert toxicity.disguised(w) == bool(toxicity.DISGUISED.search(w)), w
    learned = {}
    for k, t, y in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            learned[t] = max(y, learned.get(t, 0))
    assert abs(sum(model.score(t) - y for t, y in learned.items())) < 0.005 * len(learned)
    assert spark.createDataFrame([(t, y) for t, y in learned.items()], "text string, y int").exceptAll(toxicity.labelled_texts(df, df, "toxic", 4, 2)).count() == 0


def toxic_model():
    chars = Counter()
    for w in "what you are an idiot a stupid moron so is he the fine day we went there and here it was good loser".split():
        chars.update(f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))
    return toxicity.ToxicModel({g: n * 50 for g, n in chars.items()}, {"idiot": (6.0, 1.0, 0.0), "stup*": (6.0, 0.0, 0.0), "moron": (6.0, 0.0, 0.0), "fine": (-0.5, 0.0, 0.0)}, -4.5)


def test_spread_words_anywhere_in_a_run():
    model = toxic_model()
    for bad in ("what a i d i o t", "y o u s t u p i d", "y o u a r e a n i d i o t", "s o   s t u p i d", "i t w a s a g o o d d a y a n d w e w e n t t h e r e y o u m o r o n", "h e - i - s - a - m - o - r - o - n"):
        assert model.score(bad) > 0.5, bad
    for fine in ("a f i n e d a y", "_" * 200 + "x", "- " * 200, "i t w a s a g o o d d a y"):
        assert model.score(fine) < 0.3, fine


def test_logistic_weights_equal_a_plain_fit():
    """Weights at which the penalised loss is flat, for and against; a score is the plain sum of its features' weights."""
    r = np.random.default_rng(5)
    x = (r.random((300, 6)) < 0.3).astype(float)
    y = (x @ [3, -2, 0, 1, 0, 0] + r.standard_normal(300) * 0.5 > 0.4).astype(float)
    extra = r.random(300) * 3
    w, slope, bias = toxicity.logistic([np.flatnonzero(row).tolist() for row in x], extra, y, 6, 1.0, 2000)
    p = 1 / (1 + np.exp(-(x @ w + slope * extra + bias)))
    assert np.abs(x.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05 and w[0] > 1 and w[1] < -0.5
    model = toxicity.ToxicModel({}, {"abcd*": (1.0, 2.0, -0.5), "xyz": (-1.0, 0.0, 0.0)}, -1.0, 0.25)
    for text, total in (("", 0), ("abcdx", 1), ("abcdx abcdy xyz", 1 + 2 - 1), ("abcd1q abcdx abcdy abcdz abcdw " * 500, 1 + 2 - 0.5)):
        n = len(set(text.split()))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(1 - total - 0.25 * math.log1p(n))))


def test_disguise_in_tokens_of_any_length_and_by_every_sign():
    model = toxic_model()
    assert all(toxicity.DISGUISED.search(f"m{c}oron") for c in (toxicity.BETWEEN | set(toxicity.LEET)) - {"\n", "\t", " "})
    for bad in ("st" + "u" * 90 + "pid", "you-" * 20 + "1d10t", "1d1ot" * 20, "id\u200biot", "mo\u00adron", "m/o/r/o/n", "i,d,i,o,t", "you/m0r0n"):
        assert model.score(f"he is {bad} there") > 0.5, bad
    for fine in ("and/or", "a" * 5000, "go" * 60 + "1", "well-known"):
        assert model.score(fine) < 0.3, fine


def test_language_model(docs, empty):
    rows = odd_rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    counts = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(ws := [*words(t), None]), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, t, *_ in rows), key=str)
    old, lm_scoring.TOP_WORDS = lm_scoring.TOP_WORDS, 5
    try:
        out = lm_scoring.score_lm(docs).collect()
    finally:
        lm_scoring.TOP_WORDS = old
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in out), key=str) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert lm_scoring.score_lm(empty).count() == 0


def test_mixing_is_a_distribution_and_learns():
    texts = [b"the thin then ", b"on the other"] * 50
    coder = lm_scoring.Coder(*lm_scoring.tree_counts([(b"the", 9), (b"on", 5)], 3))
    tables = [np.zeros((s, 2), np.int64) for s in lm_scoring.SIZES]
    blank = lm_scoring.MixModel(coder, [(t[:, 0], t[:, 1]) for t in tables])
    total = sum(2.0 ** -blank.bits_of([bytes([a])])[0] for a in range(256))
    assert total < 1
    for s, y, _ in (coder.bits_of(texts),):
        for x, t in zip(s, tables, strict=True):
            np.add.at(t, (x, y), 1)
    fit = lm_scoring.MixModel(coder, [(t[:, 0], t[:, 1]) for t in tables])
    assert fit.bits_of([b"the other then"])[0] < 0.5 * blank.bits_of([b"the other then"])[0]
    one = np.concatenate([fit.bits_of([t]) for t in texts[:6]])
    assert np.allclose(one, fit.bits_of(texts[:6]))
    assert sum(2.0 ** -fit.bits_of([bytes([a])])[0] for a in range(256)) < 1


def test_mixing_equals_a_plain_loop():
    """One stream for each text, however long: bit after bit, weights and levels changed once a block."""
    r = random.Random(4)
    texts = [(" ".join(r.choice(["the", "then", "other", "on", "x1"]) for _ in range(n))).encode() for n in (1, 40, 900)] + [b""]
    coder = lm_scoring.Coder(*lm_scoring.tree_counts([(b"the", 9), (b"other", 5)], 3))
    tables = [np.zeros((s, 2), np.int64) for s in lm_scoring.SIZES]
    for x, t in zip((b := coder.bits_of(texts[1:2]))[0], tables, strict=True):
        np.add.at(t, (x, b[1]), 1)
    model = lm_scoring.MixModel(coder, [(t[:, 0], t[:, 1]) for t in tables])
    L = lm_scoring.LEVELS
    for text, total in zip(texts, model.bits_of(texts), strict=True):
        slots, y, _ = coder.bits_of([text])
        xs = [[float(l[k]) for k in x] for l, x in zip(model.logit, slots, strict=True)]
        seen = [[int(np.float32(v).view(np.int32)) & 15 for v in x] for x in xs]
        w = [list(map(float, row)) for row in lm_scoring.START]
        level = [1 / (1 + math.exp(-(i - (L - 1) / 2) * (12 / L))) for i in range(L)]
        cost, at = 0.0, 0
        while at < len(y):
            dw, dl = [[0.0] * 3 for _ in w], [0.0] * L
            for i in range(at, min(at + lm_scoring.BLOCK, len(y))):
                g = (seen[1][i] + seen[2][i]) >> 1
                logit = sum(xs[k][i] * w[g][k] for k in range(3))
                p, k = 1 / (1 + math.exp(-logit)), int(min(max(logit * L / 12 + L / 2, 0), L - 1))
                mixed = (p + level[k]) / 2
                cost -= math.log2(max(mixed if y[i] else 1 - mixed, 1e-6))
                dl[k] += lm_scoring.TRUST * (y[i] - level[k])
                for j in range(3):
                    dw[g][j] += lm_scoring.RATE * (y[i] - p) * xs[j][i]
            w = [[a + b for a, b in zip(row, d, strict=True)] for row, d in zip(w, dw, strict=True)]
            level = [min(max(a + b, float(lm_scoring.LEAST)), 1 - float(lm_scoring.LEAST)) for a, b in zip(level, dl, strict=True)]
            at += lm_scoring.BLOCK
        assert total == pytest.approx(cost, rel=2e-3, abs=0.05)
    assert lm_scoring.digits_for(0) == lm_scoring.digits_for(1 << 28) == lm_scoring.DIGITS and lm_scoring.digits_for(1 << 36)[0] == lm_scoring.DIGITS[0] + 2


def closure(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_simhash(docs, empty, monkeypatch):
    assert [simhash.ranges_to_agree(n, 4) for n in (1, 10**7, 10**9, 10**12)] == [1, 1, 2, 4]
    rows = odd_rows()

    def fp(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 4]).encode(), 42) for k in range(max(1, len(ws) - 3))] if ws else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))

    fps = [fp(t) for _, t, *_ in rows]
    for tile, radius in ((4096, 4), (2, 4), (2, 26)):
        monkeypatch.setattr(simhash, "TILE", tile)
        root = closure(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= radius])
        least = {}
        for k, (i, *_) in enumerate(rows):
            if i is not None:
                least[root[k]] = min(i, least.get(root[k], i))
        out = simhash.simhash_duplicates(docs, 4, radius, None)
        have = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out.collect()), key=str)
        assert have == sorted(((i, fps[k], least.get(root[k])) for k, (i, *_) in enumerate(rows)), key=str)
    assert simhash.simhash_duplicates(empty, 4, 4, None).count() == 0
    nodes = docs.sparkSession.createDataFrame([(x - (1 << 64) if x >> 63 else x, x - (1 << 64) if x >> 63 else x) for x in set(fps)], "fp long, node long")
    for agree in (2, 3):  # the same components, whatever number of ranges names a bucket
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(nodes, 6, agree).collect()]
        assert closure(set(fps), links) == closure(set(fps), [(a, b) for a in set(fps) for b in set(fps) if a < b and bin(a ^ b).count("1") <= 6])
    monkeypatch.setattr(simhash, "SKETCH_TILE", 2)
    near = simhash.simhash_duplicates(docs, 5, 8, 0.8).collect()
    assert len(near) == len(rows)
    by_text = {}
    for (i, t, *_), in zip(rows):
        by_text.setdefault(t or "", set()).add(i)
    same = {r.doc_id: r.component_id for r in near if r.doc_id is not None}
    assert all(len({same[i] for i in ids if i is not None}) <= 1 for ids in by_text.values())
    assert simhash.simhash_duplicates(empty).count() == 0


def shingle_set(t, size=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    return frozenset(tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def jaccard_roots(rows, least):
    """The smallest id reachable over pairs of rows (id, text) of that exact similarity, by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    return closure(sets, [(a, b) for a in sets for b in sets if b < a and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)])


def test_near_copies_beyond_the_radius(spark, monkeypatch):
    r = random.Random(9)
    rows = []
    for k in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 200, 500]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(r.randint(1, 3)):
            other = list(words)
            for at in r.sample(range(len(words)), max(1, int(len(words) * r.choice([0.01, 0.02, 0.025, 0.03])))):
                other[at] = f"x{r.randrange(5000)}"
            rows.append((len(rows), " ".join(other)))
    sets = [shingle_set(t) for _, t in rows]
    fps = [simhash_bits(s) for s in sets]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert sum(bin(fps[a] ^ fps[b]).count("1") > 8 for a, b in linked) >= 10
    want = jaccard_roots(rows, 0.8)
    for tile in (256, 2):
        monkeypatch.setattr(simhash, "SKETCH_TILE", tile)
        assert {x.doc_id: x.component_id for x in simhash.simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8, 0.8).collect()} == want


def test_similarity_is_decided_by_whole_sets(spark):
    rows, r = [], random.Random(10)
    for k in range(40):  # a text and its beginning: 50 to 400 shingles, a share of 0.78 to 0.82 of them in both
        n = r.choice([50, 100, 200, 400])
        words = [f"w{k}x{i}" for i in range(n + 4)]
        cut = round(n * r.choice([0.78, 0.79, 0.8, 0.81, 0.82]))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: cut + 4]))]
    out = {x.doc_id: x.component_id for x in simhash.simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8, 0.8).collect()}
    assert out == jaccard_roots(rows, 0.8)
    assert 5 < sum(out[2 * k + 1] == 2 * k for k in range(40)) < 35


def simhash_bits(shingles):
    hs = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, None), (None, None)]
    out = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = closure({x for ab in real for x in ab}, real)
    assert out == want


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = r.standard_normal((6, 8))
    rows = [(i, (base[i % 6] + r.standard_normal(8) * 0.06).tolist(), i % 2) for i in range(80)]
    rows += [(100, rows[0][1], 0), (101, rows[0][1], 0), (102, rows[0][1], 1), (103, [x * 3 for x in rows[0][1]], 0), (104, None, 0), (105, [0.0] * 8, 0), (106, [1.0, None] * 4, 0), (107, [float("nan")] * 8, 0), (108, rows[0][1], None), (109, [1.0, 2.0], 0), (110, [2.0, 4.0], 0), (111, [], 0), (112, [float("inf")] * 8, 0)]

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))

    good = [(i, v, g) for i, v, g in rows if g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    linked = [(i, j) for k, (i, v, g) in enumerate(good) for j, w, h in good[:k] if g == h and len(v) == len(w) and cos(v, w) >= 0.98]
    n = Counter(x for ab in linked for x in ab)
    root = closure([i for i, *_ in rows], linked)
    want = sorted((i, n[i], root[i], root[i] == i) for i, *_ in rows)
    df = spark.createDataFrame([(*x, "v") for x in rows], "vec_id long, embedding array<double>, label int, k string")
    for tile in (512, 4):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        assert sorted(tuple(x) for x in embedding_dedup.cosine_duplicates(df, 0.98).collect()) == want
    assert embedding_dedup.cosine_duplicates(df.limit(0), 0.98).count() == 0


def test_embeddings_with_negative_zeros(spark):
    rows = [(0, [0.0, 1.0, 2.0], 0), (1, [-0.0, 1.0, 2.0], 0), (2, [0.0, 1.0, 2.0], 0), (3, [-0.0, 1.0, -2.0], 0), (4, [-0.0, -0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(1)
    want = [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert sorted(tuple(x) for x in embedding_dedup.cosine_duplicates(df, 0.98).collect()) == want


def test_decontamination(spark, docs, empty, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
    items = spark.createDataFrame([(1, item), (2, "qq"), (3, None), (None, "q"), (1, item), (4, "")], "item_id long, text string")
    typos = item.replace("quick", "quik").replace("lazy", "lazzy")
    texts = ["so " + item.upper() + " end", "x" + typos.replace(" ", "\n"), item[:50], "none of it", None, "", "a qq top"]
    rows = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    out = {r.doc_id: [(m.item_id, m.distance) for m in r.matches] for r in decontamination.contamination(rows, items).collect()}
    assert out == {0: [(1, 0)], 1: [(1, 2)], 2: [], 3: [], 4: [], 5: [], 6: [(2, 0)]}
    clash = rows.withColumn("matches", F.lit("mine"))
    found = decontamination.contamination(clash, items)
    assert found.columns == [*clash.columns, "matches_"] and {r.matches for r in found.collect()} == {"mine"}
    assert sorted(r.doc_id for r in decontamination.clean_documents(clash, items).collect()) == [2, 3, 4, 5]
    monkeypatch.setattr(decontamination, "PART", 60)  # many parts, one after another
    assert {r.doc_id: sorted((m.item_id, m.distance) for m in r.matches) for r in decontamination.contamination(rows, items).collect()} == out
    assert decontamination.contamination(docs, items.limit(0)).where("size(matches) > 0").count() == 0
    assert decontamination.contamination(empty, items).count() == 0

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        return min(row)

    r = random.Random(4)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(2))
        assert decontamination.myers(p, t)[0] == distance(p, t)


def test_decontamination_equals_edit_distance_everywhere(spark):
    """All items against all windows of all texts, by plain dynamic programming."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) for _ in range(40)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, sentence(r.randint(1, 12))) for i in range(12)]
    texts = []
    for i in range(40):
        t = sentence(30)
        for _ in range(2):
            x = list(r.choice(items)[1])
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(x))
                x[at : at + r.randint(0, 1)] = r.choice(["", "q", "zz"[: r.randint(0, 2)]])
            cut = r.randrange(len(t))
            t = t[:cut] + " " + "".join(x) + " " + t[cut:]
        texts.append((i, t))

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        return min(row)

    want = {i: sorted((k, n) for k, x in items for p in [decontamination.plain(x)] for n in [least(p, decontamination.plain(t))] if n <= int(len(p) * 0.08)) for i, t in texts}
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {x.doc_id: sorted((m.item_id, m.distance) for m in x.matches) for x in decontamination.contamination(df, bench).collect()} == want


def test_warc(spark, monkeypatch, tmp_path):
    import base64

    monkeypatch.setattr(warc, "FRAME", 200)
    monkeypatch.setattr(warc, "BUNDLE", 400)
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["<a>" * 50, "b", "<a>" * 50, "", None, "é\r\n\r\nz", "b", "c" * 5000, "<a>" * 50])] + [(20, None, "u\nrl"), (21, "a\r\nb", "d")]
    df = spark.createDataFrame([(*p, "s") for p in pages], "page_id long, url string, html string, sha string")
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(i, last.get(h or "", i))
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in pages)
    bundles = warc.write_bundles(df)
    assert sorted(tuple(r) for r in warc.read_bundles(bundles).collect()) == want
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0
    import zstandard

    wanted = spark.createDataFrame([(0,), (2,), (7,), (999,), (None,), (7,)], "page_id long")
    found = {r.page_id: r for r in warc.find_records(bundles, wanted).collect()}
    assert sorted(found) == [0, 2, 7] and bytes(found[7].payload) == b"c" * 5000 and found[0].payload is None and found[0].refers_to == 8
    for r in warc.export_bundles(bundles, f"file://{tmp_path}").collect():
        data = (tmp_path / r.path.rsplit("/", 1)[1]).read_bytes()
        reads = []
        frames = warc.BundleReader(read_at=lambda start, size, data=data, reads=reads: reads.append(size) or data[start : start + size], total=len(data))
        whole = b"".join(frames.frame(i) for i in range(len(frames.places) - 1))
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == whole  # other readers skip the index and the table
        for page_id, *at in frames.index():  # by the file alone
            head, payload = warc.parse(frames.read(*at))
            assert head["warc-record-id"] == f"<urn:page:{page_id}>" and frames.read(*at) in frames.find(page_id)
            assert head["content-type"].startswith("application/http")


def test_warc_with_odd_ids(spark):
    rows = [(None, "u", "same"), (None, "v", "same"), (3, "w", "other"), (3, "w", "other"), (None, "x", "other"), (3, "y", "third")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got_ = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_bundles(warc.write_bundles(df)).collect()), key=str)
    assert got_ == sorted([(None, 4, "response", None)] * 2 + [(3, 5, "response", None)] * 2 + [(None, 5, "revisit", 3), (3, 5, "response", None)], key=str)


def brute_cut(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[k : k + length] for _, x in raws for k in range(len(x) - length + 1))
    out = []
    for i, x in raws:
        spans = merge([(k, k + length) for k in range(len(x) - length + 1) if seen[x[k : k + length]] > 1])
        out.append((i, len(x), sum(b - a for a, b in spans), len(spans), hashlib.sha256(suffix_dedup.keep(x, spans)).hexdigest()))
    return sorted(out, key=str)


def brute_words(texts, length):
    """Each text without what runs of `length` words cover that repeat."""
    words = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    seen = Counter(tuple(w for *_, w in ws[k : k + length]) for ws in words for k in range(len(ws) - length + 1))
    out = []
    for t, ws in zip(texts, words, strict=True):
        spans = merge([(ws[k][0], ws[k + length - 1][1]) for k in range(len(ws) - length + 1) if seen[tuple(w for *_, w in ws[k : k + length])] > 1])
        out.append(None if t is None else suffix_dedup.keep(t.encode(), spans).decode())
    return out


def test_suffix_dedup(spark, docs, empty, monkeypatch):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    for group in (192 << 10, 1):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        for length in (40, 400):
            assert got(suffix_dedup.cut_digests(docs, length)) == brute_cut(rows, length), (group, length)
    assert suffix_dedup.cut_digests(empty).count() == 0


def test_suffix_dedup_carries_clashing_columns(spark, docs):
    rows = odd_rows()
    named = docs.withColumn("_whole", F.lit("w")).withColumn("spans", F.col("n")).withColumn("Whole", F.lit(1)).drop("score")
    for words, length in ((False, 40), (True, 5)):
        kept = suffix_dedup.cut_repeats(named, length, words)
        assert kept.columns == named.columns
        rest = [c for c in named.columns if c != "text"]
        assert got(kept.select(*rest)) == got(named.select(*rest))
        if words:
            assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, brute_words([t for _, t, *_ in rows], length)))


def test_suffix_dedup_of_long_and_periodic_texts(spark, monkeypatch):
    """Periodic texts, long words, many near copies of one passage, texts over the block and run sizes."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    passage = " ".join(word() for _ in range(70))
    texts = ["ab" * 700, "xyz " * 400, "q" * 3000, "w" * 500 + " " + "w" * 90, " ".join(word() for _ in range(2500))]
    texts += [" ".join(word() for _ in range(r.randint(0, 20))) + " " + passage + " " + " ".join(word() for _ in range(r.randint(0, 20))) for _ in range(60)]
    texts += [texts[4][300:900] + " " + passage[5:200], passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group, run, block in ((3000, 50, 700), (1, 8192, 1 << 18)):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        monkeypatch.setattr(suffix_dedup, "RUN", run)
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert got(suffix_dedup.cut_digests(df, 100)) == brute_cut(list(enumerate(texts)), 100), group
        kept = {x.doc_id: x.text for x in suffix_dedup.cut_repeats(df, 12, words=True).collect()}
        assert [kept[i] for i in range(len(texts))] == brute_words(texts, 12), group


def test_suffix_dedup_with_frequent_lines_between_unique_text(spark, monkeypatch):
    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = ["".join(r.choice(letters) for _ in range(50)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(8):
            parts += [r.choice(lines), "".join(r.choice(letters) for _ in range(r.randint(3, 45)))]
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group, length in ((192 << 10, 40), (4000, 100), (1, 40)):
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        assert got(suffix_dedup.cut_digests(df, length)) == brute_cut(rows, length), (group, length)


def test_spans_of_large_groups_move_a_row_a_place(spark, monkeypatch):
    """One passage in many different texts, and two in some: no row for each window or span on the way back to the places."""
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    one, two = (" ".join(word() for _ in range(60)) for _ in range(2))
    texts = [" ".join([word(), word(), one, word(), *([two] * (k % 3)), word(), word()]) for k in range(40)]
    plans, table = [], suffix_dedup.as_table
    monkeypatch.setattr(suffix_dedup, "as_table", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(df, tag))
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)
    kept = {x.doc_id: x.text for x in suffix_dedup.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 50, words=True).collect()}
    assert [kept[i] for i in range(len(texts))] == brute_words(texts, 50)
    assert plans and not any("Generate" in x for x in plans)


def test_suffix_order():
    r = random.Random(6)
    for _ in range(400):
        s = [r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for _ in range(200):
        texts = [b" ".join(r.choice([b"a", b"b", b"cc"]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 4))]
        seen = Counter(tuple(ws[i : i + 4]) for ws in map(bytes.split, texts) for i in range(len(ws) - 3))
        for t, spans in zip(texts, repeated_words(texts, 4), strict=True):
            at = [(m.start(), m.end()) for m in re.finditer(rb"\S+", t)]
            assert spans == merge([(at[i][0], at[i + 3][1]) for i in range(len(at) - 3) if seen[tuple(t.split()[i : i + 4])] > 1])
    for _ in range(400):
        length, letters = r.choice([2, 6, 12]), r.choice([b"ab ", b"a", b"abcdefg \n"])
        texts = [bytes(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 4))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        assert repeated_spans(texts, length) == [merge([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]) for t in texts]


def test_matches_that_begin_with_a_word_here_and_inside_one_there(monkeypatch):
    """A string of 400 bytes that begins with a word of one text and inside a word of another; what is around its start repeats in two more."""
    r = random.Random(44)
    word = lambda: "".join(r.choice("bcdefgh") for _ in range(r.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n)) + " "
    one, two, tail = some(10) + "a ", some(10) + "xa ", some(90)[:398]
    texts = [(some(20) + x).encode() for x in (one + tail + "! " + some(9), two + tail + "? " + some(9), one + tail[:200] + "# ", two + tail[:200] + "; ")]
    want = [merge([(k, k + 400) for k in range(len(t) - 399) if sum(t[k : k + 400] in x for x in texts) > 1]) for t in texts]
    assert [len(x) for x in want] == [1, 1, 0, 0] and repeated_spans(texts, 400) == want
    monkeypatch.setattr("notelake.llm.suffix_order.GRAM", 4)
    for _ in range(300):
        length = r.choice([12, 24, 40])
        words = r.sample(["a ", "xa ", "bxa ", "b\n", "ab ", " ", "cab ", "n\n", "ein "], r.randint(2, 6))
        base = [r.choice(words) for _ in range(50)]
        texts = ["".join(r.choice(words) if r.random() < 0.06 else w for w in base[r.randint(0, 20) :]).encode() for _ in range(5)]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        assert repeated_spans(texts, length) == [merge([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]) for t in texts]


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_run(spark, name):
    table = {"op6_embedding_dedup": "embeddings", "op8_warc": "pages"}.get(name, "documents")
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_sql_twin(spark):
    from compare import connect, differ

    from notelake.llm.queries import ORACLE_SQL

    con = connect(SF)
    for name, sql in ORACLE_SQL.items():
        assert differ(spark, con, QUERIES[name], sql, SF) is None


def test_near_duplicate_stage_equals_exact_components(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    sets = {i: shingle_set(t) for i, t in rows}
    at = {}  # only texts that share a shingle can be similar
    for i, x in sets.items():
        for g in x or [None]:
            at.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in at.values() for a in ids for b in ids if b < a}
    linked = [(a, b) for a, b in pairs if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    root = closure(sets, linked)
    near = [(a, b) for a, b in linked if sets[a] != sets[b]]
    found = {r.doc_id: r.component_id for r in simhash.simhash_duplicates(docs, 5, 8, 0.8).collect()}
    assert near and sum(found[a] == found[b] for a, b in near) / len(near) == 1  # recall
    kept = [r.doc_id for r in p.near_duplicates(spark, docs, "/root/testdata/sf0.01").collect() if r.doc_id is not None]
    assert sorted(kept) == sorted(i for i in sets if root[i] == i)


def test_near_duplicate_stage_computes_only_what_decides(spark, monkeypatch):
    """Whole sets decide, so no fingerprint is made; what follows reads the kept rows only."""
    import corpus_pipeline as p

    def unwanted(h):
        raise AssertionError("a fingerprint that decides nothing")

    plain = [f"w{k}" for k in range(90)]
    rows = [(4, " ".join(plain)), (2, " ".join([*plain[:-1], "other"])), (9, " ".join(plain)), (7, "something else altogether"), (8, " ".join(plain[:45]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprint", unwanted)
    kept = p.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8]
    assert sorted(r.doc_id for r in p.encoding(spark, kept, "").collect()) == [2, 7, 8]


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    have = {r.doc_id: r for r in p.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.collect()}
        assert ids <= {r.doc_id for r in kept.collect()}, name
        if name == "repeated_passages":
            before = kept.collect()
            texts = {r.doc_id: r.text for r in after.collect()}
            assert [texts[r.doc_id] for r in before] == brute_words([r.text for r in before], 50)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r.doc_id for r in kept.collect() if not any(x in r.text for x in items)} >= ids
            assert not [r for r in after.collect() if any(x in r.text for x in items)]
        kept = after
    assert set(have) == {r.doc_id for r in kept.collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, _key string, matches string, spans int"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, texts that share an id, names like those that the stages use."""
    plain = " ".join(f"w{k % 37}x{k % 11}" for k in range(80))
    texts = [plain, plain, plain + " more", "", None, " \n", "x", "long " * 30_000, plain.upper(), "some other words than those"]
    rows = [(k, t, "en", "s", len(t or ""), f"k{k}", f"m{k}", k) for k, t in enumerate(texts)]
    rows += [(3, "another text of the same id", None, None, None, None, None, None), rows[2], (None, plain, "en", None, 1, "k", "m", 1), (None,) * 8]
    return spark.createDataFrame(rows, ODD)


def test_stages_with_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(k, k % 2) for k in range(10)] + [(None, 1), (4, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some other words than"), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_documents(spark)
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    every = Counter(tuple(r) for r in docs.select(*rest).collect())
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert not Counter(tuple(r) for r in out.select(*rest).collect()) - every, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name == "near_duplicates":
            kept = out.collect()
            assert sorted(r.text for r in kept if r.doc_id == 3) == ["", "another text of the same id"]
            assert sum(r.doc_id is None for r in kept) == 2 and {r.doc_id for r in kept if r.doc_id is not None} == {0, 3, 6, 7, 9}
        if name == "repeated_passages":
            assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, brute_words([r.text for r in docs.collect()], 50)))
        if name == "decontamination":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == {9}
    last = p.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() == docs.count() and last(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_passages_of_just_over_fifty_words_go(spark):
    """Short words, so that fifty of them are far fewer than 400 bytes; runs of forty-nine stay."""
    import corpus_pipeline as p

    r = random.Random(41)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6)))
    long_, short = ([word() for _ in range(n)] for n in (51, 49))
    rows = [(k, " ".join([word() for _ in range(30)] + (long_ if k < 4 else short if k < 8 else []) + [word() for _ in range(30)])) for k in range(12)]
    out = {x.doc_id: x.text for x in p.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert [k for k, t in rows if out[k] != t] == [0, 1, 2, 3] and all(len(out[k].split()) == 60 for k in range(4))
