"""Tempo maps, durations, chords and voices at render time, loudness and gain, and training histories."""

import math

from ..plans.engine import query, view
from .notes import in_beats


@query
def tempo_asof(d):
    """Events in beats: by the last tempo change at or before them, at the first tempo before all changes."""
    points = f"SELECT user_id AS piece_id, event_id, {d.micros('ts')} / 1000000e0 AS t FROM events"
    return f"SELECT piece_id, event_id, round(beat, 3) AS beat FROM ({in_beats(d, points, ['event_id'])}) b"


@query
def fill_durations(d):
    """Each note lasts to the next onset, max_beats at most, and no less than it did; the last onset's notes last max_beats."""
    most = round(float(d.p.max_beats) / float(d.p.grid))
    return f"SELECT n.piece_id, n.st, n.pitch, greatest(n.ds, least({most}, coalesce(o.next_st - o.st, {most}))) AS ds FROM notes n JOIN (SELECT piece_id, st, lead(st) OVER (PARTITION BY piece_id ORDER BY st) AS next_st FROM (SELECT DISTINCT piece_id, st FROM notes) x) o ON n.piece_id = o.piece_id AND n.st = o.st"


@view
def timed(d):
    """Pitched notes with their places in whole microseconds, at each piece's first tempo."""
    at = lambda x: f"CAST({d.rint(f'{x} * 60000000e0 / t.bpm')} AS BIGINT)"
    return f"SELECT p.piece_id, p.note_ord, p.pitch, least(127, greatest(1, p.vel)) AS vel, t.bpm, {at('p.start_beats')} AS us, {at('p.start_beats')} + {at('p.dur_beats')} AS end_us FROM pitched p JOIN first_tempo t ON p.piece_id = t.piece_id"


@view
def sessions(d):
    """Chords: notes whose onset is no more than chord_gap seconds after the one before."""
    gap = round(float(d.p.chord_gap) * 1e6)
    return f"SELECT piece_id, note_ord, pitch, us, sum(fresh) OVER (PARTITION BY piece_id ORDER BY us, pitch, note_ord ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY piece_id ORDER BY us, pitch, note_ord) <= {gap} THEN 0 ELSE 1 END AS fresh FROM timed) x"


@query
def chord_sessions(d):
    return "SELECT piece_id, grp, count(*) AS n, min(pitch) AS low, max(pitch) AS high FROM sessions GROUP BY piece_id, grp"


@query
def chord_roles(d):
    """A note's place in its chord: top (of equals the last), bottom (the first), inner, or alone."""
    return "SELECT piece_id, note_ord, n, CASE WHEN n = 1 THEN 'alone' WHEN up = 1 THEN 'top' WHEN up = n THEN 'bottom' ELSE 'inner' END AS role FROM (SELECT piece_id, note_ord, row_number() OVER (PARTITION BY piece_id, grp ORDER BY pitch DESC, us DESC, note_ord DESC) AS up, count(*) OVER (PARTITION BY piece_id, grp) AS n FROM sessions) x"


@query
def polyphony(d):
    """Notes sounding at each note's onset: those that began up to chord_gap seconds after it, less those that have ended, one at least."""
    gap = round(float(d.p.chord_gap) * 1e6)
    marks = f"SELECT piece_id, us - {gap} AS t, 1 AS step, 0 AS here FROM timed UNION ALL SELECT piece_id, end_us, -1, 0 FROM timed UNION ALL SELECT piece_id, us, 0, 1 FROM timed"
    return f"SELECT piece_id, t AS us, greatest(1, CAST(n AS BIGINT)) AS n FROM (SELECT piece_id, t, max(here) AS here, sum(sum(step)) OVER (PARTITION BY piece_id ORDER BY t) AS n FROM ({marks}) m GROUP BY piece_id, t) x WHERE here = 1"


def _from_beat(d, beats):
    """Seconds from the nearest multiple of `beats` beats, at the piece's first tempo."""
    period = f"({beats} * 60000000e0 / bpm)"
    return f"abs(us - {period} * {d.rint(f'us / {period}')}) / 1000000e0"


@query
def beat_snap(d):
    """Notes within `near` seconds of a beat, and which of them are so near a bar line."""
    near = d.num(d.p.near)
    return f"SELECT piece_id, note_ord, {_from_beat(d, 4)} < {near} AS on_bar FROM timed WHERE {_from_beat(d, 1)} < {near}"


@query
def median_velocity(d):
    return "SELECT piece_id, CAST(median(vel) AS DOUBLE) AS median_vel, count(DISTINCT vel) <= 1 AS flat FROM stepped GROUP BY piece_id"


@query
def shaped_velocities(d):
    """Velocities with accents: bar lines and beats louder, the rest softer; a chord's top, and its bottom if it has three notes, lifted, its inner notes softened.

    Offsets are for a median velocity of 100. No noise is added."""
    near = d.num(d.p.near)
    accent = f"CASE WHEN {_from_beat(d, 4)} < {near} THEN 8e0 WHEN {_from_beat(d, 1)} < {near} THEN 3e0 ELSE -4e0 END"
    role = "CASE WHEN r.role = 'top' THEN CASE WHEN r.n >= 3 THEN 6e0 ELSE 4e0 END WHEN r.n < 3 THEN 0e0 WHEN r.role = 'bottom' THEN 2e0 WHEN r.role = 'inner' THEN -8e0 ELSE 0e0 END"
    base = "SELECT piece_id, greatest(1e0, CAST(median(vel) AS DOUBLE)) / 100 AS base FROM timed GROUP BY piece_id"
    return f"SELECT t.piece_id, t.note_ord, CAST(least(127, greatest(1, {d.rint(f'round(t.vel + b.base * (t.accent + {role}), 9)')})) AS BIGINT) AS vel FROM (SELECT *, {accent} AS accent FROM timed) t JOIN chord_roles r ON t.piece_id = r.piece_id AND t.note_ord = r.note_ord JOIN ({base}) b ON t.piece_id = b.piece_id"


@query
def partials(d):
    """The overtones of each pitch and velocity that occurs, for a struck string: frequency, amplitude (of unit energy), decay rate."""
    top = d.num(0.95 * int(d.p.sample_rate) / 2)
    detune = 2 ** (0.7 / 1200) - 1
    vn, f0 = "(vel / 127e0)", "(440e0 * pow(2e0, (pitch - 69) / 12e0))"
    fn = f"(n * {f0} * sqrt(1e0 + 1e-4 * pow(10e0, (pitch - 21) / 40e0) * n * n))"
    amp = f"pow(n, -(1.45e0 - 0.85e0 * {vn})) * (0.35e0 + 0.65e0 * abs(sin(pi() * n / 7.3e0))) / (1e0 + pow(fn / (2500e0 + 6000e0 * {vn}), 2e0)) / sqrt(1e0 + pow(110e0 / fn, 4e0))"
    scale = "pow(2e0, -(pitch - 60) / 14e0)"
    kinds = "SELECT DISTINCT pitch, vel FROM notes"
    base = f"SELECT *, {amp} AS amp FROM (SELECT pitch, vel, CAST(n AS DOUBLE) AS n, {fn} AS fn FROM ({kinds}) k {d.series('1', '40', 'n')}) x"
    both = f"SELECT pitch, vel, 2 * n - 1 AS part, fn * {d.num(1 + detune)} AS hz, 0.72e0 * amp AS amp, 1e0 / (0.45e0 * {scale}) * (1e0 + 0.30e0 * (n - 1)) AS rate FROM ({base}) a UNION ALL SELECT pitch, vel, 2 * n, fn * {d.num(1 - detune)}, 0.28e0 * amp, 1e0 / (3e0 * {scale}) * (1e0 + 0.45e0 * (n - 1)) FROM ({base}) b"
    kept = f"SELECT * FROM (SELECT *, max(amp) OVER (PARTITION BY pitch, vel) AS most FROM ({both}) y) z WHERE hz < {top} AND amp > 1e-3 * most"
    return f"SELECT pitch, vel, CAST(part AS BIGINT) AS part, round(hz, 6) AS hz, round(amp / sqrt(sum(amp * amp) OVER (PARTITION BY pitch, vel)), 9) AS amp, round(rate, 6) AS rate FROM ({kept}) w"


@view
def signal(d):
    """A signal (place, x), by default the events' values over 500 in the order of their ids."""
    return "SELECT event_id AS place, value / 500e0 AS x FROM events"


@view
def blocks(d):
    """The signal cut into blocks: mean power over the block's size (a short last one is padded with silence), and peak."""
    b = int(d.p.block)
    return f"SELECT {d.div('place', b)} AS block, sum(x * x) / {b} AS power, count(*) AS n, sum(x * x) AS total, max(abs(x)) AS peak FROM signal GROUP BY {d.div('place', b)}"


@query
def block_power(d):
    return "SELECT block, round(power, 9) AS power, round(peak, 9) AS peak FROM blocks"


def _db(x, factor=10):
    return f"CASE WHEN {x} > 0 THEN {factor} * log10({x}) ELSE CAST('-Infinity' AS DOUBLE) END"


@query
def loudness_gate(d):
    """Loudness of the full blocks over an absolute gate and over a hundredth of the mean of those, by the plain mean without any full block; and the plain mean and the peak."""
    full = f"SELECT power FROM blocks WHERE n = {int(d.p.block)} AND power > 1e-7"
    gated = f"SELECT avg(power) AS p, count(*) AS n FROM ({full}) a CROSS JOIN (SELECT avg(power) AS m FROM ({full}) b) c WHERE a.power > 0.01e0 * c.m"
    whole = f"SELECT sum(total) / sum(n) AS p, max(peak) AS peak, sum(CASE WHEN n = {int(d.p.block)} THEN 1 ELSE 0 END) AS full_blocks FROM blocks"
    gate = "CASE WHEN w.full_blocks > 0 THEN coalesce(g.p, 0e0) ELSE w.p END"
    return f"SELECT round({_db(gate)}, 6) AS db, g.n, round({_db('w.p')}, 6) AS plain_db, round({_db('w.peak', 20)}, 6) AS peak_db FROM ({gated}) g CROSS JOIN ({whole}) w"


SPAN = 4096  # blocks whose running minimum is taken together


@query
def limiter_gain(d):
    """Gain in dB that holds each block's peak, and its neighbours', under the ceiling, and is released at a fixed rate: a running minimum against a slope, in spans, then over the spans."""
    need = f"SELECT block, least(0e0, {d.num(d.p.ceiling_db)} - 20 * log10(greatest(peak, 1e-12))) AS g FROM blocks"
    near = " UNION ALL ".join(f"SELECT block + {k} AS block, g, {int(k == 0)} AS own FROM ({need}) n{k + 1}" for k in (-1, 0, 1))
    rate = d.num(d.p.release_db)
    mins = f"SELECT block, {d.div('block', SPAN)} AS span, min(g) - block * {rate} AS x FROM ({near}) a GROUP BY block HAVING max(own) = 1"
    spans = f"SELECT span, min(m) OVER (ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT span, min(x) AS m FROM ({mins}) q GROUP BY span) s"
    return f"SELECT m.block, round(m.block * {rate} + least(min(m.x) OVER (PARTITION BY m.span ORDER BY m.block ROWS UNBOUNDED PRECEDING), coalesce(s.before, 1e300)), 9) AS gain FROM ({mins}) m JOIN ({spans}) s ON m.span = s.span"


@query
def gain_ramp(d):
    """Linear interpolation between block centres: the step in each block towards the next one's level."""
    return f"SELECT a.block, round((b.power - a.power) / {int(d.p.block)}, 9) AS slope FROM blocks a LEFT JOIN blocks b ON b.block = a.block + 1"


@query
def compressor_gain(d):
    """Gain in dB that follows a soft-knee target, fast down and slow up: each block's gain depends on the last one's, so blocks are folded in order, some hundreds at a time."""
    knee, slope = 6.0, 1 - 1 / float(d.p.ratio)
    over = f"(10 * log10(greatest(power, 1e-12)) - {d.num(d.p.threshold_db)})"
    target = f"-{d.num(slope)} * CASE WHEN {over} <= {-knee / 2}e0 THEN 0e0 WHEN {over} >= {knee / 2}e0 THEN {over} ELSE pow({over} + {knee / 2}e0, 2e0) / {2 * knee}e0 END"
    down, up = (math.exp(-1 / float(x)) for x in (d.p.attack_blocks, d.p.release_blocks))
    rows = f"SELECT block, {target} AS t FROM blocks"

    def step(now, t):
        return f"CASE WHEN {t} < {now} THEN {d.num(down)} * {now} + {d.num(1 - down)} * {t} ELSE {d.num(up)} * {now} + {d.num(1 - up)} * {t} END"

    if d.name == "spark":
        chunks = f"SELECT {d.div('block', 512)} AS c, {d.held('struct(block, t)', 'block')} AS xs FROM ({rows}) r GROUP BY {d.div('block', 512)}"
        none = "CAST(array() AS ARRAY<STRUCT<block: BIGINT, g: DOUBLE>>)"
        inner = f"aggregate(xs, named_struct('now', a.now, 'g', {none}), (b, x) -> named_struct('now', {step('b.now', 'x.t')}, 'g', concat(b.g, array(named_struct('block', x.block, 'g', {step('b.now', 'x.t')})))))"
        outer = f"aggregate(cs, named_struct('now', 0e0, 'g', CAST(array() AS ARRAY<ARRAY<STRUCT<block: BIGINT, g: DOUBLE>>>)), (a, xs) -> named_struct('now', ({inner}).now, 'g', concat(a.g, array(({inner}).g))))"
        return f"SELECT y.block, round(y.g, 6) AS gain FROM (SELECT explode(c) AS y FROM (SELECT explode(({outer}).g) AS c FROM (SELECT {d.held('xs', 'c')} AS cs FROM ({chunks}) k) a) e) z"
    return f"""SELECT block, round(g, 6) AS gain FROM (WITH RECURSIVE s AS MATERIALIZED (SELECT block, t, row_number() OVER (ORDER BY block) AS k FROM ({rows}) r), recursion_gain AS (SELECT k, block, {step('0e0', 't')} AS g FROM s WHERE k = 1
        UNION ALL SELECT s.k, s.block, {step('f.g', 's.t')} FROM recursion_gain f JOIN s ON s.k = f.k + 1) SELECT * FROM recursion_gain) x"""


def _fold(d, state, first, update, out):
    """A fold over the epochs in order. state: names; first: their values before; update: the new ones from f.<name> and the epoch's h.<column>; out: columns of f (before), g (after) and h."""
    columns = ("epoch", "val_loss")
    if d.name == "spark":
        new = lambda now: ", ".join(f"'{k}', {x.replace('f.', now + '.').replace('h.', 'x.')}" for k, x in update.items())
        start = "named_struct(" + ", ".join(f"'{k}', {x}" for k, x in first.items()) + ")"
        folded = f"aggregate(hs, array(named_struct('s', {start}, 'h', CAST(NULL AS STRUCT<epoch: BIGINT, val_loss: DOUBLE>))), (acc, x) -> concat(acc, array(named_struct('s', named_struct({new('element_at(acc, -1).s')}), 'h', x))))"
        pick = ", ".join(x.replace("f.", "p.before.").replace("g.", "p.now.s.").replace("h.", "p.now.h.") + f" AS {k}" for k, x in out.items())
        pairs = "transform(sequence(1, size(all) - 1), i -> named_struct('before', all[i - 1].s, 'now', all[i]))"
        return f"SELECT {pick} FROM (SELECT explode({pairs}) AS p FROM (SELECT {folded} AS all FROM (SELECT {d.held('struct(CAST(epoch AS BIGINT) AS epoch, val_loss)', 'epoch')} AS hs FROM history) a WHERE size(hs) > 0) b) c"
    names = ", ".join(state)
    begun = ", ".join(f"{x} AS {k}" for k, x in first.items())
    after = ", ".join(f"{update[k]} AS {k}" for k in state)
    prior = ", ".join(f"f.{k} AS before_{k}" for k in state)
    pick = ", ".join(x.replace("f.", "before_").replace("g.", "").replace("h.", "") + f" AS {k}" for k, x in out.items())
    source = f"SELECT {', '.join(columns)}, row_number() OVER (ORDER BY epoch) AS k FROM history"
    return f"""SELECT {pick} FROM (WITH RECURSIVE h0 AS MATERIALIZED ({source}), recursion_fold AS (SELECT h.k, h.epoch, h.val_loss, {prior}, {after} FROM h0 h CROSS JOIN (SELECT {begun}) f WHERE h.k = 1
        UNION ALL SELECT h.k, h.epoch, h.val_loss, {prior}, {after} FROM recursion_fold f JOIN h0 h ON h.k = f.k + 1) SELECT k, epoch, val_loss, {names}, {', '.join('before_' + k for k in state)} FROM recursion_fold) z"""


@query
def early_stopping(d):
    """Which epochs improve on the best by more than min_delta, how many have passed since one did, and whether training stops after the epoch."""
    patience = int(d.p.patience)
    better = f"h.val_loss < f.best - {d.num(d.p.min_delta)}"
    update = {"best": f"CASE WHEN {better} THEN h.val_loss ELSE f.best END", "stale": f"CASE WHEN {better} THEN 0 ELSE f.stale + 1 END"}
    stop = f"g.stale >= {patience}" if patience > 0 else "false"
    return _fold(d, ("best", "stale"), {"best": "CAST('Infinity' AS DOUBLE)", "stale": "CAST(0 AS BIGINT)"}, update, {"epoch": "h.epoch", "improved": "g.stale = 0", "stale": "g.stale", "stops": stop})


@query
def plateau_lr(d):
    """The rate of each epoch, and after it: cut by a factor when more than lr_patience epochs in a row have not improved on the best by a ten-thousandth."""
    better = "h.val_loss < f.best * (1 - 1e-4)"
    bad = f"(CASE WHEN {better} THEN 0 ELSE f.bad + 1 END)"
    cut = f"{bad} > {int(d.p.lr_patience)}"
    update = {"best": f"CASE WHEN {better} THEN h.val_loss ELSE f.best END", "bad": f"CASE WHEN {cut} THEN 0 ELSE {bad} END", "lr": f"CASE WHEN {cut} THEN greatest(f.lr * {d.num(d.p.lr_factor)}, {d.num(d.p.min_lr)}) ELSE f.lr END"}
    first = {"best": "CAST('Infinity' AS DOUBLE)", "bad": "CAST(0 AS BIGINT)", "lr": d.num(d.p.lr)}
    return _fold(d, ("best", "bad", "lr"), first, update, {"epoch": "h.epoch", "lr": "f.lr", "lr_after": "g.lr"})


@query
def cosine_lr(d):
    """The rate at the start of each epoch, on half a cosine from lr to its floor over all planned epochs."""
    lr, low = float(d.p.lr), float(d.p.lr) * float(d.p.min_lr_ratio)
    return f"SELECT epoch, round({d.num(low)} + {d.num(lr - low)} * (1 + cos(pi() * least(epoch - 1, {int(d.p.epochs)}) / {d.num(d.p.epochs)})) / 2, 12) AS lr FROM history"


@query
def epoch_loss(d):
    """Token-weighted means without batches that are no number; perplexity of a loss of 20 at most."""
    mean = lambda x: f"sum({x} * n) FILTER (WHERE NOT isnan({x})) / sum(n) FILTER (WHERE NOT isnan({x}))"
    return f"SELECT round({mean('train_loss')}, 6) AS loss, round(exp(least({mean('val_loss')}, 20e0)), 4) AS val_ppl FROM history"


@query
def resume_history(d):
    """The epochs up to the one that training goes on from; later ones are dropped."""
    return f"SELECT epoch, train_loss, val_loss FROM history WHERE epoch <= {int(d.p.resume_epoch)}"


@query
def memory_estimate(d):
    """Bytes of a training step for batches of 1 to `batch`: three copies of the logits, six activations for each layer and step, and four copies of the weights, of four bytes each."""
    h, n, e, length = int(d.p.hidden), max(1, int(d.p.layers)), int(d.p.embed), int(d.p.seq_len)
    v = str(int(d.p.vocab_size)) if d.p.vocab_size else "v.n"
    fixed = 4 * h * (e + h) + 8 * h + (n - 1) * (8 * h * h + 8 * h)
    source = "(SELECT 1 AS n) v" if d.p.vocab_size else "(SELECT count(*) AS n FROM vocab_ids) v"
    logits, act, params = f"12 * b * {length} * {v}", f"{24 * n * length * h} * b", f"16 * ({v} * {e} + {fixed} + {h} * {v} + {v})"
    return f"SELECT b AS batch, {logits} AS logits, {act} AS activations, {params} AS params, {logits} + {act} + {params} AS bytes FROM {source} {d.series('1', str(int(d.p.batch)), 'b')}"


@query
def epoch_cost(d):
    """Targets and steps of an epoch over all windows, and its minutes at tokens_per_second."""
    length, b = int(d.p.length), int(d.p.batch)
    return f"SELECT w AS windows, w * {length} AS targets, {d.div(f'w + {b} - 1', b)} AS steps, round(w * {length} / {d.num(d.p.tokens_per_second)} / 60, 6) AS minutes FROM (SELECT CAST(sum(windows) AS BIGINT) AS w FROM window_counts) x"
