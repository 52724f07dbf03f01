"""Literal cases: symbols to notes and back, windows, sampling, metrics, training histories, with parameters."""

import math

import pytest

from notelake.operators.codec import SCHEMES, Encoder
from notelake.operators.metrics import format_report
from notelake.operators.sampling import derived_seed, generate
from notelake.plans import engine

NOTES = "piece_id long, st long, pitch long, ds long, vel long"
SYMBOLS = "piece_id long, pos long, symbol string"


def symbols(spark, *texts):
    return spark.createDataFrame([(i, k, s) for i, t in enumerate(texts) for k, s in enumerate(t.split(" "))], SYMBOLS)


def decoded(spark, scheme, text, columns=("pitch", "start", "duration"), **params):
    df = Encoder(scheme, **params).decode(symbols(spark, text))
    rows = []
    for r in df.collect():
        r = r.asDict()
        start = r["st"] * params.get("grid", 0.25)
        rows.append((r["pitch"], round(start, 6), round(r["ds"] * params.get("grid", 0.25), 6) if "ds" in r else r.get("duration", 0.25)))
    return sorted(rows, key=lambda x: (x[1], x[0]))


def notes(spark, *rows):
    return spark.createDataFrame([(1, *r, 80) if len(r) == 3 else (1, *r) for r in rows], NOTES)


@pytest.mark.parametrize(
    "text, want",
    [
        ("T40 N60 D48 T1 N61 D1", [(60, 10, 12), (61, 10.25, 0.25)]),
        ("D4 N60 D8 D16 T4 D3 N62 D4", [(60, 0, 2), (62, 1, 1)]),
        ("N60 N64 D4 T4 N62 T2 N65 D1", [(60, 0, 0.5), (64, 0, 1), (62, 1, 0.5), (65, 1.5, 0.25)]),
        ("N60 <bad> D8 T4 N62 D4", [(60, 0, 0.5), (62, 1, 1)]),
        ("N60 <PAD> D8 T4 N62 D4", [(60, 0, 2), (62, 1, 1)]),
        ("N60  D8 T4 N62 D4", [(60, 0, 2), (62, 1, 1)]),
        ("Nx D8 T4 N62 D4", [(62, 1, 1)]),
        ("N999 T0 T-1 T4 N62 D4 N128 T4000 D0", [(62, 1, 1)]),
    ],
)
def test_event_decoder(spark, text, want):
    assert decoded(spark, "event", text) == want


def test_event_velocities(spark):
    got = Encoder("event", velocity_bins=8).decode(symbols(spark, "N60 V3 D4 N61 V9 D4 N62 D4 V2")).collect()
    assert sorted((r.pitch, r.ds, r.vel) for r in got) == [(60, 4, 56), (61, 2, 80), (62, 4, 80)]
    got = Encoder("event", velocity_bins=8).encode(notes(spark, (0, 60, 4, 56))).collect()
    assert [r.symbol for r in sorted(got, key=lambda r: r.pos)] == ["N60", "V3", "D4"]


@pytest.mark.parametrize("bins", [1, 2, 3, 8, 16, 32, 127])
def test_velocity_bins(spark, bins):
    from notelake.operators.notes import bin_centre, velocity_bin
    from notelake.plans.dialect import Spark

    d = Spark()
    rows = spark.sql(f"SELECT b, {bin_centre(d, 'b', bins)} AS c, {velocity_bin(d, bin_centre(d, 'b', bins), bins)} AS back FROM (SELECT explode(sequence(0L, {bins - 1}L)) AS b)").collect()
    assert all(r.b == r.back and 1 <= r.c <= 127 for r in rows)


@pytest.mark.parametrize("caps, gap, want", [(16, 1, "T1"), (16, 16, "T16"), (16, 17, "T16 T1"), (16, 40, "T16 T16 T8"), (16, 32, "T16 T16"), (4, 10, "T4 T4 T2"), (1, 3, "T1 T1 T1")])
def test_greedy_runs(spark, caps, gap, want):
    assert engine.run(spark, "encode_event", notes=notes(spark, (gap, 60, 4)), max_shift=caps).first().symbols == want + " N60 D4"


def test_event_encoder_clamps(spark):
    raw = spark.createDataFrame([(1, 0, "t", False, 60, 0.0, 10.0, 80), (1, 1, "t", False, 62, 1.0, 0.1, 80), (1, 2, "t", False, 62, 1.0, 0.05, 80)], "piece_id long, note_ord long, track string, is_drum boolean, pitch long, start_beats double, dur_beats double, vel long")
    assert engine.run(spark, "encode_event", raw_notes=raw, min_duration=0.05).first().symbols == "N60 D32 T4 N62 D1"
    assert engine.run(spark, "encode_event", raw_notes=raw, min_duration=0.05, grid=0.5, max_duration=64).first().symbols == "N60 D20 T2 N62 D1"


@pytest.mark.parametrize("bad", ["<REST:>", "<REST:abc>", "<REST:0>", "<REST:-3>", "<REST: 4>".replace(" ", "_"), "<REST:2.5>", "<REST:x>", "<REST:1025>", "<REST:99999999999999999999>"])
def test_malformed_rests_take_no_time(spark, bad):
    assert decoded(spark, "note_chord", f"{bad} 60 {bad} <REST:2> 62 {bad}") == [(60, 0, 0.25), (62, 0.75, 0.25)]
    assert decoded(spark, "interval", f"{bad} 0 {bad} C+4 <REST:2> C+5 +2 {bad}") == [(60, 0, 0.25), (64, 0, 0.25), (62, 0.75, 0.25)]
    assert decoded(spark, "pitch_duration", f"{bad} P60 {bad} D1.5 <REST:2> D9 P62 {bad}") == [(60, 0, 1.5), (62, 0.75, 0.25)]


def test_lenient_decoders(spark):
    assert decoded(spark, "note_chord", "60 <UNK> 62 60..64 60.200 a.b 65_0.062 66_x 67_-1 60.60 <STYLE:Jazz> <EOS>") == [(60, 0, 0.25), (62, 0.5, 0.25), (60, 0.75, 0.25), (64, 0.75, 0.25), (65, 1.0, 0.062), (60, 1.25, 0.25), (60, 1.25, 0.25)]
    assert decoded(spark, "interval", "C+3 +100 <UNK> C+5 -200 C-4 Cx +3.5 7") == [(127, 0, 0.25), (127, 0, 0.25), (0, 0.25, 0.25), (0, 0.25, 0.25), (7, 0.5, 0.25)]
    assert decoded(spark, "pitch_duration", "D4 P60 junk D2.0 D3.0 P200 Px P61 <UNK> Dx D0 D-1 D0.5") == [(60, 0, 2.0), (61, 0.25, 0.5)]


def test_interval_encoder(spark):
    assert engine.run(spark, "encode_interval", notes=notes(spark, (0, 48, 1), (0, 60, 4))).first().symbols == "-12 C+12"


def test_clamped_walk_over_block_borders(spark):
    import random

    r = random.Random(3)
    steps = [r.choice([-90, -7, -1, 0, 2, 5, 80]) for _ in range(1500)]
    now, want = 60, []
    for x in steps:
        now = max(0, min(127, now + x))
        want.append(now)
    got = Encoder("interval").decode(symbols(spark, " ".join(f"{x:+d}" if x else "0" for x in steps))).collect()
    assert [x.pitch for x in sorted(got, key=lambda x: x.st)] == want


@pytest.mark.parametrize("scheme", list(SCHEMES))
@pytest.mark.parametrize("grid", [0.25, 1 / 3])
def test_round_trips(spark, scheme, grid):
    rows = [(3, 60, 1), (7, 64, 1), (40, 30, 1), (41, 90, 1)]
    codec = Encoder(scheme, grid=grid)
    back = codec.decode(codec.encode(notes(spark, *rows)))
    assert sorted((r.st, r.pitch) for r in back.collect()) == sorted((s, p) for s, p, _ in rows)
    with pytest.raises(ValueError, match="there are"):
        Encoder("nope")


def test_transposing_commutes_with_encoding(spark):
    base = notes(spark, (0, 60, 1), (0, 64, 2), (5, 50, 3))
    for name, whole in (("encode_event_transpositions", "encode_event"), ("encode_interval_transpositions", "encode_interval"), ("encode_pitch_duration_transpositions", "encode_pitch_duration")):
        got = {r.k: r.symbols for r in engine.run(spark, name, notes=base).collect()}
        assert sorted(got) == list(range(-6, 7))
        for k in (-6, 0, 3):
            moved = notes(spark, (0, 60 + k, 1), (0, 64 + k, 2), (5, 50 + k, 3))
            assert engine.run(spark, whole, notes=moved).first().symbols == got[k]


def test_vocabularies(spark):
    count = lambda name, **p: engine.run(spark, name, **p).count()
    assert (count("codec_vocabulary"), count("codec_vocabulary", velocity_bins=8)) == (176, 184)
    assert (count("rest_vocabulary"), count("interval_vocabulary")) == (15, 1 + 15 + 255 + 127)


def tokens(spark, *rows):
    return spark.createDataFrame([(i, k, s, None) for i, x in enumerate(rows) for k, s in enumerate(x)], "seq_id long, pos long, symbol string, style string")


def test_training_vocabulary(spark):
    t = tokens(spark, ["a"] * 5 + ["b"] * 5 + ["c"] * 3 + ["d"] + ["z"] * 9)
    split = spark.createDataFrame([(0, "", "train")], "doc_id long, text string, split string")
    declared = spark.createDataFrame([("<REST:2>",), ("<REST:3>",)], "symbol string")
    keep = spark.createDataFrame([("d",), ("nowhere",)], "symbol string")
    got = engine.run(spark, "train_vocab", tokens=t, doc_split=split, declared=declared, kept_symbols=keep.limit(0), min_freq=1, max_size=3).orderBy("id").collect()
    assert [r.symbol for r in got][5:] == sorted(["z", "a", "b", "<REST:2>", "<REST:3>"]) and [r.id for r in got] == list(range(10))
    got = engine.run(spark, "train_vocab", tokens=t, doc_split=split, declared=declared, kept_symbols=keep, min_freq=5, max_size=0)
    assert {r.symbol for r in got.where("id > 4").collect()} == {"z", "a", "b", "d", "<REST:2>", "<REST:3>"}
    other = split.withColumn("split", split.split.substr(1, 0))
    assert engine.run(spark, "train_vocab", tokens=t, doc_split=other, declared=declared.limit(0)).count() == 5


def test_vocabulary_mismatch(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "symbol string, id long")
    b = spark.createDataFrame([("x", 0), ("z", 1), ("y", 2)], "symbol string, id long")
    assert engine.run(spark, "vocab_mismatch", vocab_ids=a, other_vocab=a).count() == 0
    assert sorted((r.id, r.symbol_a, r.symbol_b) for r in engine.run(spark, "vocab_mismatch", vocab_ids=a, other_vocab=b).collect()) == [(1, "y", "z"), (2, None, "y")]


@pytest.mark.parametrize("length, stride", [(1, 1), (4, 1), (4, 3), (8, 5), (16, 8), (8, 8)])
def test_windows_cover_every_target(spark, length, stride):
    ids = spark.createDataFrame([(n, p, 1000 * n + p) for n in range(0, 40, 3) for p in range(n)], "seq_id long, pos long, id long")
    lens = spark.createDataFrame([(n, n) for n in range(0, 40, 3)], "seq_id long, n long")
    got = engine.run(spark, "token_windows", encode_ids=ids, lengths=lens, length=length, stride=stride).collect()
    by = {}
    for r in got:
        by.setdefault((r.seq_id, r.off), []).append(r.pos)
    assert all(sorted(x) == list(range(off, off + length + 1)) for (_, off), x in by.items())
    for n in range(0, 40, 3):
        targets = {p for (s, off), x in by.items() if s == n for p in x if p > off}
        assert targets == (set(range(1, n)) if n > length else set())
    counts = {r.seq_id: r.windows for r in engine.run(spark, "window_counts", lengths=lens, length=length, stride=stride).collect()}
    assert counts == {n: sum(s == n for s, _ in by) for n in counts}


def test_ranks_and_prefix_sums(spark):
    counts = spark.createDataFrame([(50, 900), (3, 800), (17, 700), (1, 0), (9, 0), (70000, 0), (2, 5)], "id long, n long")
    got = engine.run(spark, "freq_rank", target_counts=counts).orderBy("rnk").collect()
    assert [r.id for r in got] == [50, 3, 17, 2, 1, 9, 70000] and [r.rnk for r in got] == list(range(7))
    lens = spark.createDataFrame([(3, 5), (20000, 7), (9999, 2), (45000, 1)], "seq_id long, n long")
    assert sorted((r.seq_id, r.start_at) for r in engine.run(spark, "ragged_offsets", lengths=lens).collect()) == [(3, 0), (9999, 5), (20000, 7), (45000, 14)]


def logits(spark, *rows):
    return spark.createDataFrame([(i, k, float(x)) for i, r in enumerate(rows) for k, x in enumerate(r)], "row_id long, token_id long, logit double")


def none(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "token_id long") if ids else spark.createDataFrame([], "token_id long")


def test_greedy_and_softmax_of_odd_logits(spark):
    inf, nan = math.inf, math.nan
    rows = logits(spark, [0, 5, nan, 1], [0, inf, 1], [-inf, -inf, 2], [nan, nan, nan])
    pick = {r.row_id: r.token_id for r in engine.run(spark, "greedy", logits=rows, banned=none(spark)).collect()}
    assert pick == {0: 1, 1: 1, 2: 2, 3: 0}
    p = {(r.row_id, r.token_id): r.p for r in engine.run(spark, "softmax_temperature", logits=rows, banned=none(spark), temperature=1.0).collect()}
    assert (p[1, 0], p[1, 1], p[1, 2]) == (0, 1, 0) and (0, 2) not in p and p[2, 2] == 1 and p[2, 0] == 0
    drawn = {r.row_id: r.token_id for r in engine.run(spark, "sample", logits=rows, banned=none(spark), temperature=1e-9).collect()}
    assert drawn == pick
    banned = {r.token_id for r in engine.run(spark, "sample", logits=logits(spark, *[[9, 9, 0, 0]] * 40), banned=none(spark, 0, 1), temperature=1.0).collect()}
    assert banned == {2, 3}


def test_nucleus_and_top_k(spark):
    rows = logits(spark, [math.log(x) for x in (0.5, 0.25, 0.25)])
    kept = lambda name, **p: sorted(r.token_id for r in engine.run(spark, name, logits=rows, banned=none(spark), temperature=1.0, **p).collect())
    assert kept("top_p", top_p=0.75) == [0, 1] and kept("top_p", top_p=0.1) == [0] and kept("top_p", top_p=0.0) == [0, 1, 2] == kept("top_p", top_p=1.0)
    assert kept("top_k", top_k=2) == [0, 1, 2] and kept("top_k", top_k=1) == [0] and kept("top_k", top_k=0) == [0, 1, 2]


def test_generate_draws_on_and_on(spark, tmp_path):
    from pyspark.sql import functions as F

    def scorer(now):  # the next token is the last one plus one
        last = now.groupBy("row_id").agg(F.max_by("token_id", "pos").alias("t"))
        return last.select("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("token_id"), "t").withColumn("logit", F.when(F.col("token_id") == F.col("t") + 1, 50.0).otherwise(0.0)).drop("t")

    start = spark.createDataFrame([(0, 0, 3), (1, 0, 0), (1, 1, 5)], "row_id long, pos long, token_id long")
    out = generate(scorer, start, 3, str(tmp_path), banned=none(spark))
    assert sorted((r.row_id, r.pos, r.token_id) for r in out.collect()) == [(0, 1, 4), (0, 2, 5), (0, 3, 6), (1, 2, 6), (1, 3, 7), (1, 4, 8)]
    assert derived_seed(2**63 - 2, 3) == 2


def test_copying_metrics(spark):
    docs = spark.createDataFrame([(i, "") for i in range(3)], "doc_id long, text string")
    own = tokens(spark, ["1", "2", "3", "4", "9"], ["7", "8"], [])
    items = spark.createDataFrame([(0, p, s) for p, s in enumerate("012345")], "seq_id long, pos long, symbol string")
    runs = {r.seq_id: r.run for r in engine.run(spark, "longest_common_run", documents=docs, tokens=own, item_tokens=items).collect()}
    assert runs == {0: 4, 1: 0, 2: 0}
    items = spark.createDataFrame([(0, p, s) for p, s in enumerate("123456")], "seq_id long, pos long, symbol string")
    own = tokens(spark, list("12345"), list("12349"), list("123"))
    got = {r.seq_id: r.overlap for r in engine.run(spark, "ngram_overlap", documents=docs, tokens=own, item_tokens=items, run_gram=4).collect()}
    assert got == {0: 1.0, 1: 0.5, 2: None}


def pieces(spark, n, style="x"):
    return spark.createDataFrame([(i, style, None) for i in range(n)], "piece_id long, style string, skip_reason string")


def test_set_metrics_by_brute_force(spark):
    import itertools
    import random
    from collections import Counter

    r = random.Random(8)
    rows = [(i, 2 * k + r.randint(0, 1), r.choice([60, 62, 64, 65]), 1, 80) for i in range(6) for k in range(12)]
    rows = sorted(set(rows), key=lambda x: (x[0], x[1], x[2]))
    df, p = spark.createDataFrame(rows, NOTES), pieces(spark, 6)
    seqs = [[x[2] for x in rows if x[0] == i] for i in range(6)]
    onsets = [sorted({x[1] for x in rows if x[0] == i}) for i in range(6)]
    grams = lambda s, n: [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]
    for n in (1, 2, 3, 4):
        every = [g for s in seqs for g in grams(s, n)]
        assert engine.run(spark, f"distinct_{n}", notes=df, pieces=p).first()[0] == pytest.approx(len(set(every)) / len(every), abs=1e-8)
    sets = [set(grams(s, 3)) for s in seqs]
    want = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)]
    assert engine.run(spark, "cross_overlap", notes=df, pieces=p).first()[0] == pytest.approx(sum(want) / len(want), abs=1e-8)
    counts = Counter(g for o in onsets for g in grams([b - a for a, b in zip(o, o[1:], strict=False)], 3))
    total = sum(counts.values())
    entropy = -sum(c / total * math.log(c / total) for c in counts.values()) / math.log(total)
    got = {x.label: x.diversity for x in engine.run(spark, "rhythm_diversity", notes=df, pieces=p).collect()}
    assert got["all"] == got["x"] == pytest.approx(entropy, abs=1e-8)
    report = engine.run(spark, "evaluate_report", notes=df, pieces=p).collect()
    assert {x.label for x in report} == {"x", "all"} and all(x.n_pieces == 6 and x.n_notes == len(rows) for x in report)
    assert format_report(report).count("\n") == 3 and format_report([]) == "_no results_" and format_report([{"a": None, "b": 0.5}]).endswith("| - | 0.500 |")


def test_tonal_sets_are_nearer_than_atonal_ones(spark):
    scale = (0, 2, 4, 5, 7, 9, 11)
    rows = [(k, 8 * j + i, 60 + k + x, 4 if x == 0 else 1, 80) for k in range(12) for j in range(4) for i, x in enumerate(scale)]
    rows += [(20, 8 * j + i, 67 + x, 4 if x == 0 else 1, 80) for j in range(4) for i, x in enumerate(scale)]
    rows += [(30, i, 60 + i, 1, 80) for i in range(12)]
    p = spark.createDataFrame([(i, "a", None) for i in (*range(12), 20, 30)], "piece_id long, style string, skip_reason string")
    label = spark.createDataFrame([(20, "tonal"), (30, "atonal")], "piece_id long, label string")
    ref = spark.createDataFrame([(i,) for i in range(12)], "piece_id long")
    got = {r.label: r.distance for r in engine.run(spark, "pc_distance", notes=spark.createDataFrame(rows, NOTES), pieces=p, labelled=label, reference_pieces=ref).collect()}
    assert got["tonal"] < 0.05 and got["tonal"] < got["atonal"]


def history(spark, *losses):
    return spark.createDataFrame([(i + 1, float(x), float(x), 10) for i, x in enumerate(losses)], "epoch long, train_loss double, val_loss double, n long")


def test_schedules(spark):
    h = history(spark, 3.0, 2.9, 2.95, 2.96)
    got = engine.run(spark, "plateau_lr", history=h, lr_patience=1).orderBy("epoch").collect()
    assert [r.lr_after for r in got] == [1e-3, 1e-3, 1e-3, 5e-4]
    assert [r.lr_after for r in engine.run(spark, "plateau_lr", history=h).orderBy("epoch").collect()] == [1e-3, 1e-3, 5e-4, 2.5e-4]
    got = engine.run(spark, "early_stopping", history=h, min_delta=0.2, patience=3).orderBy("epoch").collect()
    assert [(r.improved, r.stale, r.stops) for r in got] == [(True, 0, False), (False, 1, False), (False, 2, False), (False, 3, True)]
    got = engine.run(spark, "cosine_lr", history=h, epochs=4).orderBy("epoch").collect()
    assert got[0].lr == pytest.approx(1e-3) and got[2].lr == pytest.approx(5e-5 + 9.5e-4 / 2)
    assert engine.run(spark, "resume_history", history=h, resume_epoch=2).count() == 2


def test_memory_estimate(spark):
    got = {r.batch: r.bytes / 1e9 for r in engine.run(spark, "memory_estimate", vocab_size=37847, batch=64).collect()}
    assert abs(got[64] - 8.5) < 0.15 * 8.5 and abs(got[48] - 6.5) < 0.15 * 6.5


def test_filled_durations(spark):
    got = engine.run(spark, "fill_durations", notes=notes(spark, (0, 60, 1), (0, 64, 9), (4, 60, 1), (40, 62, 1), (44, 61, 30))).collect()
    assert sorted((r.st, r.pitch, r.ds) for r in got) == [(0, 60, 4), (0, 64, 9), (4, 60, 16), (40, 62, 4), (44, 61, 30)]


def test_tempo_map(spark):
    """Quarter notes at 120, from beat 8 on at 60 beats a minute: the map gives whole beats, the first tempo alone does not."""
    start = lambda k: k * 0.5 if k <= 8 else 4 + (k - 8)
    rows = spark.createDataFrame([(1, k, "t", False, 60, float(start(k)), float(start(k + 1)), 80) for k in range(60)], "piece_id long, note_ord long, track string, is_drum boolean, pitch long, start_sec double, end_sec double, vel long")
    changes = spark.createDataFrame([(1, 0.0, 120.0, 0), (1, 4.0, 60.0, 1)], "piece_id long, t_sec double, bpm double, ord long")
    given = {"raw_seconds": rows, "tempo_changes": changes, "pieces": spark.createDataFrame([(1, None, None)], "piece_id long, style string, skip_reason string")}
    got = engine.run(spark, "notes_in_beats", tempo_map=True, **given).orderBy("note_ord").collect()
    assert [r.start_beats for r in got] == list(range(60)) and all(r.dur_beats == 1 for r in got)
    assert engine.run(spark, "notes_in_beats", **given).where("note_ord = 59").first().start_beats == 2 * start(59)


def test_limiter_and_compressor(spark):
    import random

    r = random.Random(5)
    x = [r.uniform(-1, 1) * (3 if 2000 < i < 2600 else 0.2) for i in range(9000)]
    signal = spark.createDataFrame(list(enumerate(x)), "place long, x double")
    peaks = [max(map(abs, x[i : i + 50])) for i in range(0, 9000, 50)]
    g = [min(0.0, -1 - 20 * math.log10(max(p, 1e-12))) for p in peaks]
    near = [min(g[max(0, i - 1) : i + 2]) for i in range(len(g))]
    want, now = [], None
    for v in near:
        now = v if now is None else min(now + 0.4, v)
        want.append(now)
    got = [q.gain for q in engine.run(spark, "limiter_gain", signal=signal).orderBy("block").collect()]
    assert got == pytest.approx(want, abs=1e-6)
    powers = [sum(v * v for v in x[i : i + 50]) / 50 for i in range(0, 9000, 50)]
    now, want = 0.0, []
    for p in powers:
        over = 10 * math.log10(max(p, 1e-12)) + 18
        t = -0.5 * (0 if over <= -3 else over if over >= 3 else (over + 3) ** 2 / 12)
        c = math.exp(-1 / 2) if t < now else math.exp(-1 / 40)
        now = c * now + (1 - c) * t
        want.append(now)
    got = [q.gain for q in engine.run(spark, "compressor_gain", signal=signal).orderBy("block").collect()]
    assert got == pytest.approx(want, abs=1e-5)


def test_unknown_names_and_values(spark):
    with pytest.raises(ValueError, match="no view"):
        engine.run(spark, "nothing")
    with pytest.raises(TypeError, match="unknown parameters"):
        engine.run(spark, "codec_vocabulary", gridd=1)
    with pytest.raises(ValueError, match="stride"):
        engine.run(spark, "codec_vocabulary", stride=0)
