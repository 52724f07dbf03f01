"""Quality metrics of pieces and sets of pieces."""

from ..plans.engine import query, view

#: Key profiles by pitch class from the tonic (major, minor), and the scales' degrees.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
SCALES = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10)}
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


@view
def ordered(d):
    return "SELECT piece_id, st, pitch, ds, row_number() OVER (PARTITION BY piece_id ORDER BY st, pitch) AS k, lag(pitch) OVER (PARTITION BY piece_id ORDER BY st, pitch) AS prev FROM notes"


@query
def pc_histogram(d):
    """Share of sounding time by pitch class, all twelve for every piece."""
    return f"SELECT p.piece_id, c.pc, round(coalesce(h.w, 0) / p.total, 9) AS w FROM (SELECT piece_id, CAST(sum(ds) AS DOUBLE) AS total FROM notes GROUP BY piece_id) p CROSS JOIN (SELECT pc FROM (SELECT 1 AS one) o {d.series('0', '11', 'pc')}) c LEFT JOIN (SELECT piece_id, pitch % 12 AS pc, CAST(sum(ds) AS DOUBLE) AS w FROM notes GROUP BY piece_id, pitch % 12) h ON h.piece_id = p.piece_id AND h.pc = c.pc"


@view
def profiles(d):
    rows = [(t, m, (t + i) % 12, w, i) for t in range(12) for m, prof in enumerate((MAJOR, MINOR)) for i, w in enumerate(prof)]
    return "SELECT * FROM (VALUES " + ", ".join(f"({t}, {m}, {pc}, {w}e0)" for t, m, pc, w, _ in rows) + ") AS v(tonic, mode, pc, w)"


@query
def key_estimate(d):
    """The key whose profile correlates best (-2 for a flat histogram); ties go to the first tonic, major before minor."""
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))
    return f"SELECT piece_id, tonic, mode, CASE tonic {names} END || CASE mode WHEN 0 THEN ' major' ELSE ' minor' END AS key_name FROM (SELECT piece_id, tonic, mode, row_number() OVER (PARTITION BY piece_id ORDER BY round(r, 9) DESC, tonic, mode) AS rn FROM (SELECT h.piece_id, p.tonic, p.mode, CASE WHEN 12 * sum(h.w * h.w) - sum(h.w) * sum(h.w) > 1e-12 THEN (12 * sum(h.w * p.w) - sum(h.w) * sum(p.w)) / sqrt((12 * sum(h.w * h.w) - sum(h.w) * sum(h.w)) * (12 * sum(p.w * p.w) - sum(p.w) * sum(p.w))) ELSE -2e0 END AS r FROM pc_histogram h JOIN profiles p ON h.pc = p.pc GROUP BY h.piece_id, p.tonic, p.mode) c) x WHERE rn = 1"


@query
def in_key_pct(d):
    inside = " OR ".join(f"(k.mode = {m} AND (n.pitch - k.tonic + 132) % 12 IN {s})" for m, s in enumerate(SCALES.values()))
    return f"SELECT n.piece_id, round(avg(CASE WHEN {inside} THEN 1e0 ELSE 0e0 END), 9) AS in_key FROM notes n JOIN key_estimate k ON n.piece_id = k.piece_id GROUP BY n.piece_id"


@query
def repetition_rate(d):
    return "SELECT piece_id, round(coalesce(avg(CASE WHEN pitch = prev THEN 1e0 ELSE 0e0 END) FILTER (WHERE k > 1), 0), 9) AS rate FROM ordered GROUP BY piece_id"


@query
def pitch_range(d):
    return "SELECT piece_id, max(pitch) - min(pitch) AS pitch_range FROM notes GROUP BY piece_id"


@query
def unique_pitches(d):
    return "SELECT piece_id, count(DISTINCT pitch) AS n FROM notes GROUP BY piece_id"


@query
def avg_interval(d):
    return "SELECT piece_id, round(coalesce(avg(abs(pitch - prev)), 0), 9) AS avg_interval FROM ordered GROUP BY piece_id"


@view
def labelled(d):
    """The set that each piece belongs to: its style, unless another table is given. Sets are measured one by one, and all together."""
    return "SELECT piece_id, coalesce(style, '-') AS label FROM pieces"


@view
def reference_pieces(d):
    """The pieces that sets are compared with: all, unless another table is given."""
    return "SELECT piece_id FROM pieces"


@view
def arms(d):
    """Each piece with its set, and again with the set of all."""
    return "SELECT piece_id, label FROM labelled UNION ALL SELECT piece_id, 'all' FROM labelled"


def grams(source, value, n, order):
    """Runs of n values of each piece, as columns s0 to s<n - 1>."""
    cols = ", ".join(f"lead({value}, {i}) OVER (PARTITION BY piece_id ORDER BY {order}) AS s{i}" for i in range(n))
    return f"SELECT * FROM (SELECT piece_id, {cols} FROM {source}) g WHERE s{n - 1} IS NOT NULL"


def names(n, prefix=""):
    return ", ".join(f"{prefix}s{i}" for i in range(n))


@view
def gram_counts(d):
    """How often each run of one to four pitches, in the order of the notes, stands in each set."""
    parts = [f"SELECT a.label, {n} AS n, {names(n, 'g.')}{', CAST(NULL AS BIGINT)' * (4 - n)}, count(*) AS c FROM ({grams('ordered', 'pitch', n, 'k')}) g JOIN arms a ON g.piece_id = a.piece_id GROUP BY a.label, {names(n, 'g.')}" for n in (4, 3, 2, 1)]
    return " UNION ALL ".join(parts)


@query
def distinct_grams(d):
    """Distinct runs of n pitches over all of them, pooled over each set."""
    return "SELECT label, n, round(count(*) / CAST(sum(c) AS DOUBLE), 9) AS share, CAST(sum(c) AS BIGINT) AS total FROM gram_counts GROUP BY label, n"


def _distinct(n):
    def f(d):
        return f"SELECT coalesce(max(share), 0e0) AS distinct_{n}, coalesce(max(total), 0) AS total FROM distinct_grams WHERE label = 'all' AND n = {n}"

    f.__name__ = f"distinct_{n}"
    f.__doc__ = f"Of all pieces together: distinct runs of {n} pitches over all of them."
    return query(f)


for _n in (1, 2, 3, 4):
    _distinct(_n)


@view
def piece_grams(d):
    n = int(d.p.gram)
    return f"SELECT DISTINCT piece_id, {names(n)} FROM ({grams('ordered', 'pitch', n, 'k')}) g"


@view
def pair_overlaps(d):
    """Jaccard similarity of the sets of pitch runs of two pieces, for pairs that share any."""
    n = int(d.p.gram)
    same = " AND ".join(f"x.s{i} = y.s{i}" for i in range(n))
    return f"""SELECT c.a, c.b, c.n / CAST(a.n + b.n - c.n AS DOUBLE) AS j FROM (SELECT x.piece_id AS a, y.piece_id AS b, count(*) AS n
        FROM piece_grams x JOIN piece_grams y ON {same} AND x.piece_id < y.piece_id GROUP BY x.piece_id, y.piece_id) c
        JOIN (SELECT piece_id, count(*) AS n FROM piece_grams GROUP BY piece_id) a ON a.piece_id = c.a JOIN (SELECT piece_id, count(*) AS n FROM piece_grams GROUP BY piece_id) b ON b.piece_id = c.b"""


@query
def set_overlap(d):
    """Mean Jaccard similarity over all pairs of pieces of a set that have runs at all: pairs that share nothing add nothing, so only the others are joined."""
    pairs = "SELECT a.label, count(*) * (count(*) - 1) / 2 AS pairs FROM (SELECT DISTINCT piece_id FROM piece_grams) g JOIN arms a ON g.piece_id = a.piece_id GROUP BY a.label"
    sums = "SELECT a.label, sum(q.j) AS j FROM pair_overlaps q JOIN arms a ON q.a = a.piece_id JOIN arms b ON q.b = b.piece_id AND a.label = b.label GROUP BY a.label"
    return f"SELECT p.label, CASE WHEN p.pairs > 0 THEN round(coalesce(s.j, 0e0) / p.pairs, 9) ELSE 0e0 END AS overlap FROM ({pairs}) p LEFT JOIN ({sums}) s ON p.label = s.label"


@query
def cross_overlap(d):
    """Mean Jaccard similarity of the pieces' sets of pitch runs."""
    return "SELECT coalesce(max(overlap), 0e0) AS overlap FROM set_overlap WHERE label = 'all'"


@view
def gaps(d):
    """Steps between successive onsets."""
    return "SELECT piece_id, st, gap FROM (SELECT piece_id, st, st - lag(st) OVER (PARTITION BY piece_id ORDER BY st) AS gap FROM (SELECT DISTINCT piece_id, st FROM notes) o) g WHERE gap IS NOT NULL"


@query
def rhythm_diversity(d):
    """Entropy of the runs of gaps between onsets, pooled over each set, over its greatest possible value; 0 for fewer than two."""
    n = int(d.p.gram)
    counted = f"SELECT a.label, {names(n, 'g.')}, CAST(count(*) AS DOUBLE) AS c FROM ({grams('gaps', 'gap', n, 'st')}) g JOIN arms a ON g.piece_id = a.piece_id GROUP BY a.label, {names(n, 'g.')}"
    sums = f"SELECT label, sum(c) AS total, sum(c * ln(c)) AS cl FROM ({counted}) x GROUP BY label"
    return f"SELECT s.label, CASE WHEN x.total >= 2 THEN round(greatest(0e0, least(1e0, (ln(x.total) - x.cl / x.total) / ln(x.total))), 9) ELSE 0e0 END AS diversity FROM (SELECT DISTINCT label FROM arms) s LEFT JOIN ({sums}) x ON s.label = x.label"


@query
def rest_share(d):
    """The share of steps, from the first onset up to the last note's end, in which nothing sounds."""
    return f"SELECT e.piece_id, round(1 - c.n / CAST(e.total AS DOUBLE), 9) AS rest_share FROM (SELECT piece_id, max(st + ds) - min(st) AS total FROM notes GROUP BY piece_id) e JOIN (SELECT piece_id, count(DISTINCT s) AS n FROM (SELECT piece_id, s FROM (SELECT piece_id, st, ds FROM notes) n {d.series('st', 'st + ds - 1', 's')}) x GROUP BY piece_id) c ON e.piece_id = c.piece_id"


@query
def key_norm_histogram(d):
    """Pitch classes from the tonic (minor keys from their relative major's), by sounding time."""
    return "SELECT n.piece_id, (n.pitch - k.tonic - 3 * k.mode + 144) % 12 AS pc, CAST(sum(n.ds) AS BIGINT) AS w FROM notes n JOIN key_estimate k ON n.piece_id = k.piece_id GROUP BY n.piece_id, (n.pitch - k.tonic - 3 * k.mode + 144) % 12"


@query
def pc_distance(d):
    """Cosine distance of each set's pooled histogram, turned to the tonics, from that of the reference pieces; 1 without any."""
    own = "SELECT a.label, h.pc, CAST(sum(h.w) AS DOUBLE) AS w FROM key_norm_histogram h JOIN arms a ON h.piece_id = a.piece_id GROUP BY a.label, h.pc"
    ref = "SELECT h.pc, CAST(sum(h.w) AS DOUBLE) AS w FROM key_norm_histogram h JOIN reference_pieces r ON h.piece_id = r.piece_id GROUP BY h.pc"
    norm = f"SELECT sqrt(sum(w * w)) AS v FROM ({ref}) z"
    return f"SELECT a.label, round(1 - coalesce(sum(a.w * b.w) / (sqrt(sum(a.w * a.w)) * max(nb.v)), 0e0), 9) AS distance FROM ({own}) a LEFT JOIN ({ref}) b ON a.pc = b.pc CROSS JOIN ({norm}) nb GROUP BY a.label"


@query
def evaluate_report(d):
    """A row for each set of pieces, and one for all: the means of the pieces' metrics, and the metrics of the set."""
    per = {"in_key_pct": ("in_key_pct", "in_key"), "repetition_rate": ("repetition_rate", "rate"), "pitch_range": ("pitch_range", "pitch_range"), "unique_pitches": ("unique_pitches", "n"), "avg_interval": ("avg_interval", "avg_interval"), "rest_share": ("rest_share", "rest_share")}
    means = ", ".join(f"round(avg({k}_t.{c}), 6) AS {k}" for k, (_, c) in per.items())
    joins = " ".join(f"JOIN {t} {k}_t ON a.piece_id = {k}_t.piece_id" for k, (t, _) in per.items())
    notes = "SELECT piece_id, count(*) AS n FROM notes GROUP BY piece_id"
    sets = f"SELECT a.label, count(*) AS n_pieces, CAST(sum(c.n) AS BIGINT) AS n_notes, {means} FROM arms a JOIN ({notes}) c ON a.piece_id = c.piece_id {joins} GROUP BY a.label"
    distinct = "SELECT label, " + ", ".join(f"max(CASE WHEN n = {n} THEN share ELSE 0e0 END) AS distinct_{n}" for n in (1, 2, 3, 4)) + " FROM distinct_grams GROUP BY label"
    cols = ", ".join(f"coalesce(x.distinct_{n}, 0e0) AS distinct_{n}" for n in (1, 2, 3, 4))
    return f"SELECT s.*, {cols}, coalesce(o.overlap, 0e0) AS cross_overlap, r.diversity AS rhythm_div, p.distance AS pc_distance FROM ({sets}) s LEFT JOIN ({distinct}) x ON s.label = x.label LEFT JOIN set_overlap o ON s.label = o.label LEFT JOIN rhythm_diversity r ON s.label = r.label LEFT JOIN pc_distance p ON s.label = p.label"


def _token_grams(source, n):
    cols = ", ".join(f"lead(symbol, {i}) OVER (PARTITION BY seq_id ORDER BY pos) AS s{i}" for i in range(n))
    return f"SELECT seq_id, pos, {names(n)} FROM (SELECT seq_id, pos, {cols} FROM {source}) g WHERE s{n - 1} IS NOT NULL"


@query
def ngram_overlap(d):
    """The share of each document's runs of run_gram words that stand in any test item; null for documents of fewer words."""
    n = int(d.p.run_gram)
    same = " AND ".join(f"a.s{i} = b.s{i}" for i in range(n))
    hits = f"SELECT a.seq_id, round(avg(CASE WHEN b.s0 IS NULL THEN 0e0 ELSE 1e0 END), 9) AS overlap FROM ({_token_grams('tokens', n)}) a LEFT JOIN (SELECT DISTINCT {names(n)} FROM ({_token_grams('item_tokens', n)}) i) b ON {same} GROUP BY a.seq_id"
    return f"SELECT s.doc_id AS seq_id, h.overlap FROM documents s LEFT JOIN ({hits}) h ON s.doc_id = h.seq_id"


@view
def truths(d):
    """The sequence that each one is held against: a test item dealt by the document's id, unless another table is given."""
    items = "SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS rn FROM (SELECT DISTINCT seq_id FROM item_tokens) x"
    return f"SELECT d.doc_id AS seq_id, i.seq_id AS truth_id FROM documents d CROSS JOIN (SELECT count(DISTINCT seq_id) AS n FROM item_tokens) c JOIN ({items}) i ON i.rn = d.doc_id % c.n"


@view
def truth_tokens(d):
    return "SELECT seq_id, pos, symbol FROM item_tokens"


@query
def longest_common_run(d):
    """The longest run of symbols that a sequence shares with its truth, 0 where they share none: equal symbols by diagonal, runs without a gap."""
    hits = "SELECT a.seq_id, a.pos, a.pos - b.pos AS diag FROM tokens a JOIN truths t ON a.seq_id = t.seq_id JOIN truth_tokens b ON b.seq_id = t.truth_id AND b.symbol = a.symbol"
    runs = f"SELECT seq_id, max(n) AS run FROM (SELECT seq_id, diag, isl, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, diag ORDER BY pos) AS isl FROM ({hits}) h) x GROUP BY seq_id, diag, isl) y GROUP BY seq_id"
    return f"SELECT t.seq_id, coalesce(r.run, 0) AS run FROM truths t LEFT JOIN ({runs}) r ON t.seq_id = r.seq_id"


@query
def prefix_match(d):
    """How many first words a document shares with the one of the smallest id in its language, whose words alone are joined."""
    first = "SELECT f.style, t.pos, t.symbol FROM (SELECT style, min(seq_id) AS first_id FROM tokens GROUP BY style) f JOIN tokens t ON t.seq_id = f.first_id"
    return f"SELECT a.seq_id, coalesce(min(CASE WHEN b.symbol IS NULL OR a.symbol <> b.symbol THEN a.pos END), count(*)) AS matched FROM tokens a LEFT JOIN ({first}) b ON b.style = a.style AND b.pos = a.pos GROUP BY a.seq_id"


def format_report(rows) -> str:
    """A markdown table of rows (of evaluate_report, say): the columns in the order they first come in, fractions to three places, nothing as a dash."""
    rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows]
    if not rows:
        return "_no results_"
    columns = list(dict.fromkeys(c for r in rows for c in r))
    show = lambda x: "-" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    lines = [columns, ["---"] * len(columns), *([show(r.get(c)) for c in columns] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
