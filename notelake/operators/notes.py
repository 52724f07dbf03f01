"""Cleaning and grid quantisation of notes. Times are whole grid steps (st, ds) until they are shown; grid beats to a step."""

from ..plans.engine import query, view


@view
def chosen_pieces(d):
    """Pieces of the styles asked for (any case), or all."""
    styles = ", ".join("'" + str(x).lower().replace("'", "''") + "'" for x in d.p.include_styles)
    return "SELECT * FROM pieces" + (f" WHERE lower(style) IN ({styles})" if styles else "")


@query
def style_pieces(d):
    """The pieces of the styles asked for, and where each style stands in the sorted list of styles."""
    return "SELECT c.piece_id, c.style, s.ord FROM chosen_pieces c JOIN (SELECT style, row_number() OVER (ORDER BY style) - 1 AS ord FROM (SELECT DISTINCT style FROM pieces WHERE style IS NOT NULL) x) s ON c.style = s.style"


@view
def pitched(d):
    """Pitched notes that last long enough, by their duration before quantisation."""
    only = " AND piece_id IN (SELECT piece_id FROM chosen_pieces)" if d.p.include_styles else ""
    return f"SELECT * FROM raw_notes WHERE NOT is_drum AND dur_beats >= {d.num(d.p.min_duration)} AND pitch BETWEEN 0 AND 127{only}"


@view
def stepped(d):
    grid = d.num(d.p.grid)
    return f"SELECT piece_id, note_ord, track, pitch, CAST({d.rint(f'start_beats / {grid}')} AS BIGINT) AS st, greatest(1, CAST({d.rint(f'dur_beats / {grid}')} AS BIGINT)) AS ds, least(127, greatest(1, vel)) AS vel FROM pitched"


@query
def notes_filtered(d):
    return "SELECT piece_id, note_ord, pitch, round(start_beats, 6) AS start_beats, round(dur_beats, 6) AS dur_beats, vel FROM pitched"


@query
def notes_quantized(d):
    grid = d.num(d.p.grid)
    return f"SELECT piece_id, note_ord, pitch, round(st * {grid}, 6) AS start_beat, round(ds * {grid}, 6) AS duration, vel FROM stepped"


@query
def piece_min_events(d):
    return f"SELECT piece_id, count(*) AS n FROM stepped GROUP BY piece_id HAVING count(*) >= {int(d.p.min_events)}"


@query
def densest_track(d):
    """The notes of each piece's fullest track; the first by name wins ties."""
    return """SELECT s.piece_id, s.track, s.note_ord, s.pitch FROM stepped s JOIN (SELECT piece_id, track, row_number() OVER (PARTITION BY piece_id ORDER BY n DESC, track) AS rn
        FROM (SELECT piece_id, track, count(*) AS n FROM stepped GROUP BY piece_id, track) c) b ON s.piece_id = b.piece_id AND s.track = b.track AND b.rn = 1"""


@query
def first_tempo(d):
    return "SELECT p.piece_id, CASE WHEN t.bpm > 0 THEN t.bpm ELSE 120e0 END AS bpm FROM pieces p LEFT JOIN (SELECT piece_id, min_by(bpm, t_sec) AS bpm FROM tempo_changes GROUP BY piece_id) t ON p.piece_id = t.piece_id"


@query
def time_signature_ok(d):
    """All of a piece's signatures are allowed; a piece without any counts as 4/4; an empty list allows all."""
    allowed = [(int(a), int(b)) for a, b in d.p.signatures]
    if not allowed:
        return "SELECT piece_id, true AS ok FROM pieces"
    one = " OR ".join(f"(s.num = {a} AND s.den = {b})" for a, b in allowed)
    return f"SELECT p.piece_id, coalesce(bool_and({one}), {str((4, 4) in allowed).lower()}) AS ok FROM pieces p LEFT JOIN time_signatures s ON p.piece_id = s.piece_id GROUP BY p.piece_id"


@view
def reasons(d):
    return f"""SELECT p.piece_id, CASE WHEN p.skip_reason IS NOT NULL THEN p.skip_reason WHEN NOT t.ok THEN 'time_signature' WHEN r.n IS NULL THEN 'no_pitched_notes' WHEN coalesce(n.n, 0) < {int(d.p.min_events)} THEN 'too_few_events' ELSE 'kept' END AS skip_reason
        FROM pieces p JOIN time_signature_ok t ON p.piece_id = t.piece_id LEFT JOIN (SELECT piece_id, count(*) AS n FROM raw_notes WHERE NOT is_drum GROUP BY piece_id) r ON p.piece_id = r.piece_id
        LEFT JOIN (SELECT piece_id, count(*) AS n FROM stepped GROUP BY piece_id) n ON p.piece_id = n.piece_id"""


@query
def skip_reason_tally(d):
    return "SELECT skip_reason, count(*) AS n FROM reasons GROUP BY skip_reason"


@query
def kept_notes(d):
    """The clean notes of the pieces that no rule skips: what a corpus is made of."""
    return "SELECT n.piece_id, n.st, n.pitch, n.ds, n.vel FROM notes n JOIN reasons r ON n.piece_id = r.piece_id WHERE r.skip_reason = 'kept'"


@query
def merged_notes(d):
    """One note for each onset and pitch: the longest duration and, independently, the highest velocity."""
    return "SELECT piece_id, st, pitch, max(ds) AS ds, max(vel) AS vel FROM stepped GROUP BY piece_id, st, pitch"


@view
def notes(d):
    """Clean notes; each piece's first onset stands at step 0."""
    return "SELECT m.piece_id, m.st - o.first_st AS st, m.pitch, m.ds, m.vel FROM merged_notes m JOIN (SELECT piece_id, min(st) AS first_st FROM stepped GROUP BY piece_id) o ON m.piece_id = o.piece_id"


@query
def zero_shift(d):
    grid = d.num(d.p.grid)
    return f"SELECT piece_id, round(st * {grid}, 6) AS start_beat, pitch, round(ds * {grid}, 6) AS duration, vel FROM notes"


@query
def longest_per_pitch(d):
    """One note for each pitch of an onset: the longest, the first of equals, with its own velocity."""
    return "SELECT piece_id, st, pitch, ds, vel FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, st, pitch ORDER BY ds DESC, note_ord) AS rn FROM stepped) x WHERE rn = 1"


@query
def onset_groups(d):
    return "SELECT piece_id, st, count(*) AS n, min(pitch) AS low, max(pitch) AS high, max(ds) AS ds FROM notes GROUP BY piece_id, st"


def velocity_bin(d, vel, bins):
    return f"least({bins} - 1, {d.div(f'(least(127, greatest(1, {vel})) - 1) * {bins}', '127')})"


def bin_centre(d, index, bins):
    """The middle of a bin's velocities: its first one is 1 + ceil(127 b / bins)."""
    low = f"(1 + {d.div(f'{index} * 127 + {bins} - 1', bins)})"
    high = f"{d.div(f'({index} + 1) * 127 + {bins} - 1', bins)}"
    return d.div(f"{low} + {high}", "2")


@query
def velocity_bins(d):
    bins = int(d.p.velocity_bins) or 8
    return f"SELECT b.vel, b.bin, {bin_centre(d, 'b.bin', bins)} AS centre, count(*) AS n FROM (SELECT vel, {velocity_bin(d, 'vel', bins)} AS bin FROM stepped) b GROUP BY b.vel, b.bin"


@query
def midi_seconds(d):
    """Notes in seconds for output, at each piece's tempo; at least a millisecond long."""
    grid = d.num(d.p.grid)
    return f"SELECT n.piece_id, n.st, n.pitch, n.vel, round(greatest(0, n.st) * {grid} * 60 / t.bpm, 6) AS start_sec, round(greatest(0.001e0, n.ds * {grid} * 60 / t.bpm), 6) AS dur_sec, round(440 * pow(2e0, (n.pitch - 69) / 12e0), 6) AS hz FROM notes n JOIN first_tempo t ON n.piece_id = t.piece_id"


@query
def quantize_seconds(d):
    """Raw notes in seconds, snapped to the grid at each piece's tempo: one step long at least, none before 0."""
    grid, beat = d.num(d.p.grid), "(60e0 / t.bpm)"
    snap = lambda x: f"{d.rint(f'(({x}) / {beat}) / {grid}')} * {grid}"
    return f"SELECT r.piece_id, r.note_ord, r.pitch, round(greatest(0e0, {snap('r.start_sec')}) * {beat}, 6) AS start_sec, round(greatest({grid}, {snap('r.end_sec - r.start_sec')}) * {beat}, 6) AS dur_sec FROM raw_seconds r JOIN first_tempo t ON r.piece_id = t.piece_id"


@view
def tempo_segments(d):
    """Each piece's tempo changes in order, with the rate from there on and the beat at which they stand (0 for the first)."""
    rate = "CASE WHEN c.bpm > 0 THEN c.bpm ELSE t.bpm END / 60e0"
    return f"""SELECT piece_id, t_sec, rate, first_rate, n, sum(coalesce((t_sec - prev_t) * prev_rate, 0e0)) OVER (PARTITION BY piece_id ORDER BY t_sec, ord ROWS UNBOUNDED PRECEDING) AS beat FROM (
        SELECT *, lag(t_sec) OVER (PARTITION BY piece_id ORDER BY t_sec, ord) AS prev_t, lag(rate) OVER (PARTITION BY piece_id ORDER BY t_sec, ord) AS prev_rate, first_value(rate) OVER (PARTITION BY piece_id ORDER BY t_sec, ord) AS first_rate, count(*) OVER (PARTITION BY piece_id) AS n
        FROM (SELECT c.piece_id, c.t_sec, c.ord, {rate} AS rate FROM tempo_changes c JOIN first_tempo t ON c.piece_id = t.piece_id) y) x"""


def in_beats(d, points, keys):
    """points(piece_id, keys, t) with the beat of t: by the last change at or before t, at the first rate before all changes."""
    names = ", ".join(keys)
    at = "CASE WHEN c.t_sec IS NULL THEN {t} * f.first_rate ELSE c.beat + ({t} - c.t_sec) * c.rate END"
    first = "(SELECT DISTINCT piece_id, first_rate FROM tempo_segments)"
    if d.name == "spark":
        nulls = ", ".join(f"NULL AS {k}" for k in keys)
        both = f"SELECT piece_id, t_sec AS t, 0 AS side, {nulls}, struct(t_sec, rate, beat) AS c FROM tempo_segments UNION ALL SELECT piece_id, t, 1, {names}, NULL FROM ({points}) p"
        return f"SELECT x.piece_id, {names}, x.t, {at.format(t='x.t')} AS beat FROM (SELECT piece_id, t, side, {names}, last(c, true) OVER (PARTITION BY piece_id ORDER BY t, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ({both}) b) x JOIN {first} f ON x.piece_id = f.piece_id WHERE x.side = 1"
    return f"SELECT p.piece_id, {names}, p.t, {at.format(t='p.t')} AS beat FROM ({points}) p JOIN {first} f ON p.piece_id = f.piece_id ASOF LEFT JOIN tempo_segments c ON p.piece_id = c.piece_id AND p.t >= c.t_sec"


@query
def notes_in_beats(d):
    """Raw notes from seconds to beats: by the whole tempo map, or by the first tempo alone where a piece has one tempo or the map is not asked for."""
    keys = ["note_ord", "edge"]
    points = "SELECT piece_id, note_ord, 0 AS edge, start_sec AS t FROM raw_seconds UNION ALL SELECT piece_id, note_ord, 1, end_sec FROM raw_seconds"
    single = "SELECT r.*, r.start_sec * (t.bpm / 60e0) AS start_beats, (r.end_sec - r.start_sec) * (t.bpm / 60e0) AS dur_beats FROM raw_seconds r JOIN first_tempo t ON r.piece_id = t.piece_id"
    out = "piece_id, note_ord, track, is_drum, pitch, vel, round({0}, 9) AS start_beats, round({1}, 9) AS dur_beats"
    if not d.p.tempo_map:
        return f"SELECT {out.format('start_beats', 'dur_beats')} FROM ({single}) s"
    mapped = f"SELECT piece_id, note_ord, max(CASE WHEN edge = 0 THEN beat END) AS a, max(CASE WHEN edge = 1 THEN beat END) AS b FROM ({in_beats(d, points, keys)}) m GROUP BY piece_id, note_ord"
    return f"SELECT s.piece_id, s.note_ord, s.track, s.is_drum, s.pitch, s.vel, round(coalesce(m.a, s.start_beats), 9) AS start_beats, round(coalesce(m.b - m.a, s.dur_beats), 9) AS dur_beats FROM ({single}) s LEFT JOIN (SELECT m.* FROM ({mapped}) m JOIN (SELECT DISTINCT piece_id FROM tempo_segments WHERE n > 1) many ON m.piece_id = many.piece_id) m ON s.piece_id = m.piece_id AND s.note_ord = m.note_ord"
