"""Four symbol encodings of notes, their vocabularies, and their decoders, which take any symbols and raise on none."""

from ..plans.engine import query, view
from .notes import bin_centre, velocity_bin

RESERVED = "('<PAD>', '<UNK>', '<BOS>', '<EOS>', '<REST>')"
#: what a decoder reads as a pitch from 0 to 127, as a whole number, and the longest run that it believes
PITCH = "([+]?0*(12[0-7]|1[01][0-9]|[0-9]?[0-9])|-0+)"
NUMBER = "[+-]?[0-9]+"
LONGEST = 1024
DEFAULT_STEPS = 2
DEFAULT_VELOCITY = 80


@view
def onsets(d):
    """One row per onset with the steps since the onset before (from 0 for the first) and the rests they cost."""
    return f"""SELECT piece_id, st, chord, low, high, ds, top_ds, prev_st, prev_low, CASE WHEN prev_st IS NULL THEN st ELSE st - prev_st - 1 END AS rest FROM (
        SELECT *, lag(st) OVER (PARTITION BY piece_id ORDER BY st) AS prev_st, lag(low) OVER (PARTITION BY piece_id ORDER BY st) AS prev_low FROM (
        SELECT piece_id, st, {d.text_of('CAST(pitch AS STRING)', 'pitch', '.')} AS chord, min(pitch) AS low, max(pitch) AS high, max(ds) AS ds, max_by(ds, pitch) AS top_ds FROM notes GROUP BY piece_id, st) o) p"""


@query
def chord_symbols(d):
    return "SELECT piece_id, st, chord, ds FROM onsets"


@view
def rests(d):
    """Rests before onsets, taken in runs of at most max_rest."""
    cap = int(d.p.max_rest)
    return f"SELECT piece_id, st, i, least({cap}, rest - {cap} * i) AS k FROM (SELECT piece_id, st, rest FROM onsets WHERE rest > 0) r {d.series('0', d.div('rest - 1', cap), 'i')}"


@query
def rest_runs(d):
    return "SELECT piece_id, st, i, CASE WHEN k = 1 THEN '<REST>' ELSE '<REST:' || CAST(k AS STRING) || '>' END AS symbol FROM rests"


def _sequence(symbols, more=""):
    return f"SELECT piece_id, row_number() OVER (PARTITION BY piece_id ORDER BY st, kind, i) - 1 AS pos, symbol{more} FROM ({symbols}) s"


REST_ROWS = "SELECT piece_id, st, 0 AS kind, i, symbol FROM rest_runs"


@view
def note_chord(d):
    return _sequence(f"{REST_ROWS} UNION ALL SELECT piece_id, st, 1, 0, chord FROM onsets")


@query
def encode_note_chord(d):
    return f"SELECT piece_id, count(*) AS n, {d.text_of('symbol', 'pos')} AS symbols FROM note_chord GROUP BY piece_id"


def _rest_steps(d):
    """The steps of a rest symbol, null for any other."""
    run = "TRY_CAST(substr(symbol, 7, length(symbol) - 7) AS BIGINT)"
    return f"CASE WHEN symbol = '<REST>' THEN 1 WHEN {d.matches('symbol', '^<REST:[0-9]+>$')} AND {run} BETWEEN 1 AND {LONGEST} THEN {run} END"


def _clock(x):
    """Steps before a symbol, from the steps that each symbol takes."""
    return f"CAST(coalesce(sum({x}) OVER (PARTITION BY piece_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


@query
def decode_note_chord(d):
    """A chord takes a step, a rest its run, <UNK> a silent step; anything malformed is skipped and takes none."""
    grid = d.num(d.p.grid)
    at = "instr(symbol, '_')"
    body = f"CASE WHEN {at} > 0 THEN substr(symbol, 1, {at} - 1) ELSE symbol END"
    text = f"CASE WHEN {at} > 0 THEN substr(symbol, {at} + 1) ELSE '' END"
    parsed = f"SELECT piece_id, pos, symbol, {_rest_steps(d)} AS rest, {body} AS body, {text} AS dur FROM note_chord"
    valid = f"rest IS NULL AND {d.matches('body', f'^[.]*{PITCH}([.]+{PITCH})*[.]*$')} AND (dur = '' OR TRY_CAST(dur AS DOUBLE) > 0)"
    onset = f"SELECT *, coalesce({valid}, false) AS onset FROM ({parsed}) p"
    steps = "coalesce(rest, CASE WHEN onset OR symbol = '<UNK>' THEN 1 ELSE 0 END)"
    clock = f"SELECT *, {_clock(steps)} AS st FROM ({onset}) o"
    return f"SELECT piece_id, st, round(st * {grid}, 6) AS start_beat, CAST(p AS BIGINT) AS pitch, round(coalesce(TRY_CAST(dur AS DOUBLE), {grid}), 6) AS duration FROM (SELECT piece_id, st, body, dur FROM ({clock}) c WHERE onset) x {d.parts('body', '.', 'p')}"


@view
def interval_rows(d):
    signed = lambda x: f"CASE WHEN {x} > 0 THEN '+' ELSE '' END || CAST({x} AS STRING)"
    base = f"o.low - coalesce(o.prev_low, {int(d.p.reference_pitch)})"
    return f"{REST_ROWS} UNION ALL SELECT piece_id, st, 1, 0, {signed(base)} FROM onsets o UNION ALL SELECT n.piece_id, n.st, 2, n.pitch, 'C+' || CAST(n.pitch - o.low AS STRING) FROM notes n JOIN onsets o ON n.piece_id = o.piece_id AND n.st = o.st AND n.pitch > o.low"


@view
def interval_symbols(d):
    return _sequence("SELECT * FROM interval_rows")


@query
def encode_interval(d):
    return f"SELECT piece_id, count(*) AS n, {d.text_of('symbol', 'pos')} AS symbols FROM interval_symbols GROUP BY piece_id"


@view
def interval_parsed(d):
    """Steps (kind S), chord members after one (kind C) and rests (kind R), with the clock, the number of steps so far and the rests since the last."""
    number = lambda x: f"CASE WHEN {d.matches(x, f'^{NUMBER}$')} THEN TRY_CAST({x} AS BIGINT) END"
    parsed = f"SELECT piece_id, pos, {_rest_steps(d)} AS rest, {number('symbol')} AS step, CASE WHEN symbol LIKE 'C%' THEN {number('substr(symbol, 2)')} END AS member FROM interval_symbols"
    counted = f"SELECT *, {_clock('coalesce(rest, CASE WHEN step IS NOT NULL THEN 1 ELSE 0 END)')} AS st, sum(CASE WHEN step IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY pos) AS k FROM ({parsed}) p WHERE rest IS NOT NULL OR step IS NOT NULL OR member IS NOT NULL"
    return f"SELECT *, sum(CASE WHEN rest IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id, k ORDER BY pos) AS parted FROM ({counted}) c"


@view
def interval_bases(d):
    """The pitch of each step: a running sum held between 0 and 127 after each.

    A run of steps acts as one shift held between two bounds, so blocks of steps are folded side by side, then the blocks of a
    piece, then the steps of each block from its first pitch: no array grows with a piece but that of its blocks."""
    start = int(d.p.reference_pitch)
    steps = "SELECT piece_id, CAST(k AS BIGINT) AS k, st, step FROM interval_parsed WHERE step IS NOT NULL"
    if d.name == "spark":
        far = 1000000
        hold = lambda x: f"greatest(0L, least(127L, {x}))"
        within = f"greatest(-{far}L, least({far}L, y.x))"
        blocks = f"SELECT piece_id, (k - 1) div 256 AS blk, {d.held('step', 'k')} AS steps FROM ({steps}) s GROUP BY piece_id, (k - 1) div 256".replace("y -> y.x", f"y -> {within}")
        acts = f"SELECT *, aggregate(steps, named_struct('lo', -{9 * far}L, 'hi', {9 * far}L, 'by', 0L), (a, x) -> named_struct('lo', {hold('a.lo + x')}, 'hi', {hold('a.hi + x')}, 'by', a.by + x)) AS act FROM ({blocks}) b"
        starts = f"SELECT piece_id, blk, first FROM (SELECT piece_id, aggregate(acts, named_struct('now', {start}L, 'all', CAST(array() AS ARRAY<BIGINT>)), (a, x) -> named_struct('now', greatest(x.lo, least(x.hi, a.now + x.by)), 'all', concat(a.all, array(a.now)))).all AS firsts FROM (SELECT piece_id, {d.held('act', 'blk')} AS acts FROM ({acts}) a GROUP BY piece_id) g) f LATERAL VIEW posexplode(firsts) u AS blk, first"
        folded = f"SELECT b.piece_id, b.blk, slice(aggregate(b.steps, array(f.first), (a, x) -> concat(a, array({hold('element_at(a, -1) + x')}))), 2, 256) AS held FROM ({blocks}) b JOIN ({starts}) f ON b.piece_id = f.piece_id AND b.blk = f.blk"
        return f"SELECT piece_id, CAST(256 * blk + i + 1 AS BIGINT) AS k, pitch FROM ({folded}) h {d.array_at('held', 'i', 'pitch')}"
    return f"""SELECT piece_id, k, pitch FROM (WITH RECURSIVE s AS MATERIALIZED ({steps}), recursion_fold AS (SELECT piece_id, k, greatest(0, least(127, {start} + step)) AS pitch FROM s WHERE k = 1
        UNION ALL SELECT s.piece_id, s.k, greatest(0, least(127, f.pitch + s.step)) FROM recursion_fold f JOIN s ON s.piece_id = f.piece_id AND s.k = f.k + 1) SELECT * FROM recursion_fold) x"""


@query
def decode_interval(d):
    """The notes of steps and of chord members, which stand on the last step's onset and are lost after a rest or before any step."""
    both = "SELECT piece_id, k, step, coalesce(member, 0) AS up, st FROM interval_parsed WHERE step IS NOT NULL OR (member IS NOT NULL AND k > 0 AND parted = 0)"
    rows = f"SELECT x.piece_id, max(CASE WHEN x.step IS NOT NULL THEN x.st END) OVER (PARTITION BY x.piece_id, x.k) AS st, greatest(0, least(127, b.pitch + x.up)) AS pitch FROM ({both}) x JOIN interval_bases b ON x.piece_id = b.piece_id AND x.k = b.k"
    return f"SELECT piece_id, CAST(st AS BIGINT) AS st, round(st * {d.num(d.p.grid)}, 6) AS start_beat, CAST(pitch AS BIGINT) AS pitch FROM ({rows}) r"


def _duration(d, ds):
    return f"'D' || CAST({ds} * {d.num(d.p.grid)} AS STRING)"


@view
def pitch_duration_symbols(d):
    return _sequence(f"{REST_ROWS} UNION ALL SELECT piece_id, st, 1, 0, 'P' || CAST(high AS STRING) FROM onsets UNION ALL SELECT piece_id, st, 2, 0, {_duration(d, 'top_ds')} FROM onsets")


@query
def encode_pitch_duration(d):
    return f"SELECT piece_id, count(*) AS n, {d.text_of('symbol', 'pos')} AS symbols FROM pitch_duration_symbols GROUP BY piece_id"


@query
def decode_pitch_duration(d):
    """A duration belongs to the last open pitch; a rest closes it, and so does its first duration. Malformed symbols are skipped."""
    grid = d.num(d.p.grid)
    parsed = f"SELECT piece_id, pos, {_rest_steps(d)} AS rest, CASE WHEN {d.matches('symbol', f'^P{PITCH}$')} THEN TRY_CAST(substr(symbol, 2) AS BIGINT) END AS pitch, CASE WHEN symbol LIKE 'D%' AND TRY_CAST(substr(symbol, 2) AS DOUBLE) > 0 THEN TRY_CAST(substr(symbol, 2) AS DOUBLE) END AS dur FROM pitch_duration_symbols"
    state = f"SELECT *, sum(CASE WHEN pitch IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY pos) AS g, {_clock('coalesce(rest, CASE WHEN pitch IS NOT NULL THEN 1 ELSE 0 END)')} AS st FROM ({parsed}) k WHERE rest IS NOT NULL OR pitch IS NOT NULL OR dur IS NOT NULL"
    broken = f"SELECT *, sum(CASE WHEN rest IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id, g ORDER BY pos) AS brk FROM ({state}) s"
    return f"SELECT piece_id, min_by(st, pos) AS st, min_by(pitch, pos) AS pitch, round(coalesce(min_by(dur, pos) FILTER (WHERE dur IS NOT NULL AND brk = 0), {grid}), 6) AS duration FROM ({broken}) b WHERE g > 0 GROUP BY piece_id, g"


@view
def event_rows(d):
    """T moves the clock in steps of at most max_shift; each note is N, a velocity bin if there are any, and D. pitch: of N alone."""
    cap, longest, bins = int(d.p.max_shift), int(d.p.max_duration), int(d.p.velocity_bins)
    none = "CAST(NULL AS BIGINT)"
    rows = [
        f"SELECT piece_id, st, 0 AS kind, i, 'T' || CAST(least({cap}, gap - {cap} * i) AS STRING) AS symbol, {none} AS pitch FROM (SELECT piece_id, st, st - coalesce(prev_st, 0) AS gap FROM onsets) g {d.series('0', d.div('gap - 1', cap), 'i')} WHERE gap > 0",
        "SELECT piece_id, st, 1, 3 * pitch, 'N' || CAST(pitch AS STRING), pitch FROM notes",
        f"SELECT piece_id, st, 1, 3 * pitch + 2, 'D' || CAST(greatest(1, least({longest}, ds)) AS STRING), {none} FROM notes",
    ]
    if bins:
        rows.append(f"SELECT piece_id, st, 1, 3 * pitch + 1, 'V' || CAST({velocity_bin(d, 'vel', bins)} AS STRING), {none} FROM notes")
    return " UNION ALL ".join(rows)


@view
def event_symbols(d):
    return _sequence("SELECT * FROM event_rows", ", pitch")


@query
def encode_event(d):
    return f"SELECT piece_id, count(*) AS n, {d.text_of('symbol', 'pos')} AS symbols FROM event_symbols GROUP BY piece_id"


@query
def decode_event(d):
    """T moves the clock. D, and V before it, belong to the last N, unless T, a second D or garbage stands between; reserved and style symbols are skipped.

    A note without D lasts DEFAULT_STEPS. Numbers past the encoder's caps are believed up to LONGEST."""
    bins = int(d.p.velocity_bins)
    value = "TRY_CAST(substr(symbol, 2) AS BIGINT)"
    digits = d.matches("symbol", "^[TNDV][0-9]+$")
    kind = f"CASE WHEN NOT {digits} THEN 'X' WHEN symbol LIKE 'N%' AND {value} <= 127 THEN 'N' WHEN symbol LIKE 'V%' AND {value} < {bins} THEN 'V' WHEN symbol LIKE 'T%' AND {value} BETWEEN 1 AND {LONGEST} THEN 'T' WHEN symbol LIKE 'D%' AND {value} BETWEEN 1 AND {LONGEST} THEN 'D' ELSE 'X' END"
    parsed = f"SELECT piece_id, pos, {kind} AS kind, {value} AS v FROM event_symbols WHERE symbol <> '' AND symbol NOT IN {RESERVED} AND NOT {d.matches('symbol', '^<STYLE:.*>$')}"
    adv = "CASE WHEN kind = 'T' THEN v ELSE 0 END"
    state = f"SELECT *, sum(CASE WHEN kind = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY pos) AS g, {_clock(adv)} AS st FROM ({parsed}) p"
    closed = f"SELECT *, coalesce(sum(CASE WHEN kind IN ('T', 'X', 'D') THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id, g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM ({state}) s"
    vel = bin_centre(d, "v", bins) if bins else str(DEFAULT_VELOCITY)
    return f"SELECT piece_id, min_by(st, pos) AS st, min_by(v, pos) AS pitch, coalesce(min_by(v, pos) FILTER (WHERE kind = 'D' AND closed = 0), least({DEFAULT_STEPS}, {int(d.p.max_duration)})) AS ds, coalesce(max_by({vel}, pos) FILTER (WHERE kind = 'V' AND closed = 0), {DEFAULT_VELOCITY}) AS vel FROM ({closed}) b WHERE g > 0 GROUP BY piece_id, g"


def _numbered(d, prefix, low, high, name):
    return f"SELECT '{prefix}' || CAST({name} AS STRING) AS symbol FROM (SELECT 1 AS one) x_{name} {d.series(str(low), str(high), name)}"


@query
def codec_vocabulary(d):
    """The symbols that the event scheme declares."""
    rows = [_numbered(d, "T", 1, int(d.p.max_shift), "i"), _numbered(d, "D", 1, int(d.p.max_duration), "j"), _numbered(d, "N", 0, 127, "p")]
    if d.p.velocity_bins:
        rows.append(_numbered(d, "V", 0, int(d.p.velocity_bins) - 1, "b"))
    return " UNION ALL ".join(rows)


@query
def rest_vocabulary(d):
    """What the note_chord and pitch_duration schemes declare: runs of rests, which no pruning may reach."""
    return f"SELECT symbol || '>' AS symbol FROM ({_numbered(d, '<REST:', 2, int(d.p.max_rest), 'i')}) r"


@query
def interval_vocabulary(d):
    """Rests, every interval of 128 keys and every chord member."""
    return f"SELECT '<REST>' AS symbol UNION ALL SELECT symbol FROM rest_vocabulary UNION ALL {_numbered(d, '', -127, 0, 'm')} UNION ALL {_numbered(d, '+', 1, 127, 'n')} UNION ALL {_numbered(d, 'C+', 1, 127, 'c')}"


@view
def offsets(d):
    return f"SELECT k FROM (SELECT 1 AS one) x {d.series(str(int(d.p.offset_low)), str(int(d.p.offset_high)), 'k')}"


@query
def transpositions(d):
    """The transpositions of each piece whose pitches all stay on the keyboard."""
    return f"SELECT r.piece_id, o.k, r.low + o.k AS low, r.high + o.k AS high FROM (SELECT piece_id, min(pitch) AS low, max(pitch) AS high FROM notes GROUP BY piece_id) r JOIN offsets o ON o.k <> 0 AND r.low + o.k >= {int(d.p.pitch_low)} AND r.high + o.k <= {int(d.p.pitch_high)}"


@view
def keys(d):
    """Every piece as it is (k = 0) and its transpositions."""
    return "SELECT DISTINCT piece_id, CAST(0 AS BIGINT) AS k FROM notes UNION ALL SELECT piece_id, CAST(k AS BIGINT) FROM transpositions"


@query
def encode_transpositions(d):
    """The chords of originals and transpositions. Onsets are grouped once; each offset only renders them anew."""
    return f"SELECT t.piece_id, t.k, o.st, {d.text_of('CAST(o.pitch + t.k AS STRING)', 'o.pitch', '.')} AS chord FROM keys t JOIN notes o ON t.piece_id = o.piece_id GROUP BY t.piece_id, t.k, o.st"


@query
def encode_event_transpositions(d):
    """Event symbols of originals and transpositions: one sequence for each piece, of which only N changes."""
    symbol = "CASE WHEN e.pitch IS NULL THEN e.symbol ELSE 'N' || CAST(e.pitch + t.k AS STRING) END"
    return f"SELECT t.piece_id, t.k, count(*) AS n, {d.text_of(symbol, 'e.pos')} AS symbols FROM keys t JOIN event_symbols e ON t.piece_id = e.piece_id GROUP BY t.piece_id, t.k"


@query
def encode_interval_transpositions(d):
    """Interval symbols: only the first step, which is taken from the reference pitch, changes."""
    first = f"SELECT piece_id, min_by(low, st) - {int(d.p.reference_pitch)} AS step FROM onsets GROUP BY piece_id"
    step = "CASE WHEN f.step + t.k > 0 THEN '+' ELSE '' END || CAST(f.step + t.k AS STRING)"
    at = "SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY CASE WHEN symbol LIKE '<%' THEN 1 ELSE 0 END, pos) AS rn FROM interval_symbols"
    return f"SELECT t.piece_id, t.k, count(*) AS n, {d.text_of(f'CASE WHEN e.rn = 1 THEN {step} ELSE e.symbol END', 'e.pos')} AS symbols FROM keys t JOIN ({at}) e ON t.piece_id = e.piece_id JOIN ({first}) f ON t.piece_id = f.piece_id GROUP BY t.piece_id, t.k"


@query
def encode_pitch_duration_transpositions(d):
    symbol = "CASE WHEN substr(e.symbol, 1, 1) = 'P' THEN 'P' || CAST(CAST(substr(e.symbol, 2) AS BIGINT) + t.k AS STRING) ELSE e.symbol END"
    return f"SELECT t.piece_id, t.k, count(*) AS n, {d.text_of(symbol, 'e.pos')} AS symbols FROM keys t JOIN pitch_duration_symbols e ON t.piece_id = e.piece_id GROUP BY t.piece_id, t.k"


@query
def style_tokens(d):
    return "SELECT c.piece_id, c.pos + 1 AS pos, c.symbol FROM note_chord c UNION ALL SELECT p.piece_id, 0, '<STYLE:' || p.style || '>' FROM pieces p WHERE p.style IS NOT NULL"


#: name of a scheme: views of its symbols, of the encoded pieces, of the decoded notes, and of the symbols it declares
SCHEMES = {
    "note_chord": ("note_chord", "encode_note_chord", "decode_note_chord", "rest_vocabulary"),
    "interval": ("interval_symbols", "encode_interval", "decode_interval", "interval_vocabulary"),
    "pitch_duration": ("pitch_duration_symbols", "encode_pitch_duration", "decode_pitch_duration", "rest_vocabulary"),
    "event": ("event_symbols", "encode_event", "decode_event", "codec_vocabulary"),
}


class Encoder:
    """A scheme by name: encode(notes), decode(symbols) and vocabulary() over DataFrames; decode raises on no symbol."""

    def __init__(self, scheme: str, **params):
        if scheme not in SCHEMES:
            raise ValueError(f"unknown scheme {scheme!r}; there are {', '.join(SCHEMES)}")
        self.name, self.params = scheme, params
        self.symbols, self.encoded, self.decoded, self.declared = SCHEMES[scheme]

    def encode(self, notes):
        """(piece_id, pos, symbol) of notes (piece_id, st, pitch, ds, vel)."""
        from ..plans import engine

        return engine.run(notes.sparkSession, self.symbols, notes=notes, **self.params).select("piece_id", "pos", "symbol")

    def decode(self, symbols):
        """The notes of symbols (piece_id, pos, symbol)."""
        from pyspark.sql import functions as F

        from ..plans import engine

        if self.name == "event":
            symbols = symbols.withColumn("pitch", F.lit(None).cast("long"))
        return engine.run(symbols.sparkSession, self.decoded, **{self.symbols: symbols}, **self.params)

    def vocabulary(self, spark):
        from ..plans import engine

        return engine.run(spark, self.declared, **self.params)
