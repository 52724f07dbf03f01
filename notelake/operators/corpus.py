"""Splits, vocabularies, ids and windows over token sequences."""

from ..plans.engine import query, view


def ranked(source, columns, bucket, order):
    """columns of source with rn, the rank from 1 in the order (bucket, order), without bringing all rows to one task.

    bucket must agree with the order wanted: rows are numbered inside their buckets, whose sizes alone are summed in order."""
    counts = f"SELECT b, sum(c) OVER (ORDER BY b) - c AS before FROM (SELECT {bucket} AS b, count(*) AS c FROM {source} GROUP BY {bucket}) z"
    return f"SELECT {columns}, CAST(before + row_number() OVER (PARTITION BY r.b ORDER BY {order}) AS BIGINT) AS rn FROM (SELECT *, {bucket} AS b FROM {source}) r JOIN ({counts}) k ON r.b = k.b"


@query
def split_hash(d):
    """Pieces in the order of a hash of seed and id: shares of them, rounded half to even, for validation and test.

    While the two would leave nothing to train on, the larger of them (test, of equals) gives one piece back."""
    total = "count(*)"
    v, t = (f"CAST({d.rint(f'{total} * {d.num(x)}')} AS BIGINT)" for x in (d.p.val_share, d.p.test_share))
    # of v + t pieces, all but total - 1 go back: first what the larger has more, then by turns, test first
    over = "greatest(0, least(v + t, v + t - n + 1))"
    gap = "abs(v - t)"
    lead = f"least({over}, {gap})"
    more = f"({over} - {lead})"
    back_t = f"CASE WHEN t >= v THEN {lead} ELSE 0 END + {d.div(f'{more} + 1', '2')}"
    back_v = f"CASE WHEN v > t THEN {lead} ELSE 0 END + {d.div(more, '2')}"
    sizes = f"SELECT v - ({back_v}) AS v, t - ({back_t}) AS t FROM (SELECT {total} AS n, {v} AS v, {t} AS t FROM pieces) x"
    hashed = f"(SELECT piece_id, md5('{int(d.p.seed)}|' || CAST(piece_id AS STRING)) AS h FROM pieces) p"
    return f"SELECT piece_id, CASE WHEN rn <= v THEN 'val' WHEN rn <= v + t THEN 'test' ELSE 'train' END AS split FROM ({ranked(hashed, 'piece_id', 'substr(h, 1, 3)', 'h, piece_id')}) x CROSS JOIN ({sizes}) s"


@query
def piece_split(d):
    """Pieces by split, without held-out ones whose content stands in an earlier split, or before in their own (by piece_id), whatever its key."""
    keyed = "SELECT s.piece_id, s.split, c.k, CASE s.split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS ord FROM split_hash s JOIN content_key c ON s.piece_id = c.piece_id"
    return f"SELECT a.piece_id, a.split FROM (SELECT *, row_number() OVER (PARTITION BY split, k ORDER BY piece_id) AS rn, min(ord) OVER (PARTITION BY k) AS first_ord FROM ({keyed}) x) a WHERE a.split = 'train' OR (a.rn = 1 AND a.first_ord = a.ord)"


@view
def doc_split(d):
    """A split of documents by hash alone, which needs no global order."""
    val, test = float(d.p.val_share), float(d.p.test_share)
    return f"SELECT doc_id, text, CASE WHEN h < {d.num(1 - val - test)} THEN 'train' WHEN h < {d.num(1 - test)} THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, text, {d.hash_unit(str(int(d.p.seed)), 'doc_id')} AS h FROM documents) x"


@query
def heldout_antijoin(d):
    """Held-out documents whose content stands in no earlier split and not before in their own."""
    keyed = "SELECT doc_id, split, md5(text) AS k, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS ord FROM doc_split"
    return f"SELECT a.doc_id, a.split FROM (SELECT *, row_number() OVER (PARTITION BY split, k ORDER BY doc_id) AS rn FROM ({keyed}) x) a LEFT JOIN (SELECT k, min(ord) AS first_ord FROM ({keyed}) y GROUP BY k) b ON a.k = b.k AND b.first_ord < a.ord WHERE a.split <> 'train' AND a.rn = 1 AND b.k IS NULL"


@query
def content_key(d):
    """Pieces by their content up to transposition."""
    return f"SELECT piece_id, md5({d.text_of('CAST(st AS STRING) || chr(58) || CAST(p AS STRING)', 'st * 1000 + p', ',')}) AS k FROM (SELECT n.piece_id, n.st, n.pitch - m.low AS p FROM notes n JOIN (SELECT piece_id, min(pitch) AS low FROM notes GROUP BY piece_id) m ON n.piece_id = m.piece_id) x GROUP BY piece_id"


@query
def vocab_counts(d):
    return "SELECT symbol, count(*) AS n FROM tokens GROUP BY symbol"


@view
def reserved(d):
    return "SELECT '<PAD>' AS symbol, 0 AS id UNION ALL SELECT '<UNK>', 1 UNION ALL SELECT '<BOS>', 2 UNION ALL SELECT '<EOS>', 3 UNION ALL SELECT '<REST>', 4"


@view
def declared(d):
    """Symbols that an encoder declares, and that no pruning reaches: runs of rests, unless another table is given."""
    return "SELECT symbol FROM rest_vocabulary"


@view
def kept_symbols(d):
    """Symbols that no pruning reaches if the corpus has them: style tokens, unless another table is given."""
    return "SELECT DISTINCT '<STYLE:' || style || '>' AS symbol FROM tokens WHERE style IS NOT NULL"


@view
def train_counts(d):
    """Counts over the training split alone, with each document's style token in front."""
    both = "SELECT t.symbol FROM tokens t JOIN doc_split s ON t.seq_id = s.doc_id AND s.split = 'train' UNION ALL SELECT '<STYLE:' || f.style || '>' FROM (SELECT DISTINCT seq_id, style FROM tokens) f JOIN doc_split s ON f.seq_id = s.doc_id AND s.split = 'train' WHERE f.style IS NOT NULL"
    return f"SELECT symbol, count(*) AS n FROM ({both}) x GROUP BY symbol"


@view
def exempt(d):
    """Declared symbols, and those kept if found; none of the reserved."""
    return "SELECT x.symbol FROM (SELECT symbol FROM declared UNION SELECT k.symbol FROM kept_symbols k JOIN train_counts c ON k.symbol = c.symbol) x LEFT JOIN reserved r ON x.symbol = r.symbol WHERE r.symbol IS NULL"


def _top(source, limit):
    return f"SELECT symbol, n FROM {source} ORDER BY n DESC, symbol LIMIT {int(limit)}" if limit else f"SELECT symbol, n FROM {source}"


@view
def train_symbols(d):
    """What the vocabulary of the training split holds: symbols often enough, of those (with exempt ones) the max_size commonest, and all exempt ones."""
    found = f"(SELECT c.symbol, c.n FROM train_counts c LEFT JOIN reserved r ON c.symbol = r.symbol LEFT JOIN exempt e ON c.symbol = e.symbol WHERE r.symbol IS NULL AND (c.n >= {int(d.p.min_freq)} OR e.symbol IS NOT NULL) UNION ALL SELECT e.symbol, 0 FROM exempt e LEFT JOIN train_counts c ON e.symbol = c.symbol WHERE c.symbol IS NULL) f"
    return f"SELECT symbol FROM ({_top(found, d.p.max_size)}) t UNION SELECT symbol FROM exempt"


def _ids(source):
    return f"SELECT symbol, CAST(rn + 4 AS BIGINT) AS id FROM ({ranked(f'(SELECT symbol FROM {source}) v', 'symbol', 'substr(symbol, 1, 2)', 'symbol')}) x UNION ALL SELECT symbol, CAST(id AS BIGINT) FROM reserved"


@query
def train_vocab(d):
    """The vocabulary of the training split: reserved symbols, then the others in code-point order."""
    return _ids("train_symbols")


@query
def vocab_min_freq(d):
    return f"SELECT symbol, n FROM vocab_counts c WHERE n >= {int(d.p.min_freq)} AND NOT EXISTS (SELECT 1 FROM reserved r WHERE r.symbol = c.symbol)"


@query
def vocab_max_size(d):
    return _top("vocab_min_freq", d.p.max_size)


@query
def vocab_ids(d):
    """Reserved symbols first, then all others in code-point order."""
    return _ids("vocab_min_freq")


@query
def special_ids(d):
    """Ids that a sampler must not emit: padding, begin, end, styles, and <UNK> unless it is allowed."""
    unk = "" if d.p.allow_unk else " OR symbol = '<UNK>'"
    return f"SELECT id, symbol FROM train_vocab WHERE symbol IN ('<PAD>', '<BOS>', '<EOS>') OR symbol LIKE '<STYLE:%'{unk}"


@query
def encode_ids(d):
    return "SELECT t.seq_id, t.pos, coalesce(v.id, 1) AS id FROM tokens t LEFT JOIN vocab_ids v ON t.symbol = v.symbol"


@query
def decode_ids(d):
    return "SELECT e.seq_id, e.pos, coalesce(v.symbol, '<UNK>') AS symbol FROM encode_ids e LEFT JOIN vocab_ids v ON e.id = v.id"


@view
def other_vocab(d):
    """The vocabulary that vocab_ids is held against: that of the commonest symbols, unless another table is given."""
    return _ids("vocab_max_size")


@query
def vocab_mismatch(d):
    """The ids that do not name the same symbol in two vocabularies: none if they are the same."""
    return "SELECT coalesce(a.id, b.id) AS id, a.symbol AS symbol_a, b.symbol AS symbol_b FROM vocab_ids a FULL OUTER JOIN other_vocab b ON a.id = b.id WHERE a.symbol IS NULL OR b.symbol IS NULL OR a.symbol <> b.symbol"


@view
def lengths(d):
    return "SELECT seq_id, count(*) AS n FROM tokens GROUP BY seq_id"


@view
def usable_lengths(d):
    """Sequences of two tokens or more, or all where there are none."""
    return "SELECT l.seq_id, l.n FROM lengths l CROSS JOIN (SELECT max(n) AS most FROM lengths) m WHERE l.n >= 2 OR m.most < 2"


BUCKET = 10000  # ids that are summed together


def prefix_sums(d, source, key, value):
    """key, value, and the sum of value over all smaller keys, with one row for each BUCKET ids in one task."""
    b = d.div(key, BUCKET)
    sums = f"SELECT b, sum(s) OVER (ORDER BY b) - s AS before FROM (SELECT {b} AS b, sum({value}) AS s FROM {source} GROUP BY {b}) z"
    return f"SELECT r.{key}, r.{value}, CAST(k.before + sum(r.{value}) OVER (PARTITION BY r.b ORDER BY r.{key}) - r.{value} AS BIGINT) AS start_at FROM (SELECT *, {b} AS b FROM {source}) r JOIN ({sums}) k ON r.b = k.b"


@query
def ragged_offsets(d):
    return prefix_sums(d, "lengths", "seq_id", "n")


@query
def window_counts(d):
    length, stride = int(d.p.length), int(d.p.stride)
    tail = f"CASE WHEN n > {length} AND (regular - 1) * {stride} <> n - {length} - 1 THEN 1 ELSE 0 END" if d.p.cover_tail else "0"
    return f"SELECT seq_id, n, regular + {tail} AS windows FROM (SELECT seq_id, n, CASE WHEN n > {length} THEN {d.div(f'n - {length} + {stride} - 1', stride)} ELSE 0 END AS regular FROM lengths) x"


@query
def window_index(d):
    """Random access: every hundredth window of all, by its number, with the sequence it lies in and where it starts there."""
    length, stride = int(d.p.length), int(d.p.stride)
    counted = prefix_sums(d, "(SELECT seq_id, windows FROM window_counts WHERE windows > 0) w", "seq_id", "windows")
    return f"SELECT i * 100 AS idx, s.seq_id, least((i * 100 - s.start_at) * {stride}, l.n - {length} - 1) AS off FROM (SELECT seq_id, windows, start_at FROM ({counted}) c) s JOIN lengths l ON s.seq_id = l.seq_id {d.series(d.div('s.start_at + 99', '100'), d.div('s.start_at + s.windows - 1', '100'), 'i')}"


@view
def token_windows(d):
    """Each token with every window of length + 1 tokens that it lies in: its place and its sequence's length tell which."""
    length, stride = int(d.p.length), int(d.p.stride)
    first = f"greatest(0, {d.div(f'e.pos - {length} + {stride} - 1', stride)})"
    first = f"CASE WHEN e.pos <= {length} THEN 0 ELSE {first} END"
    last = f"least({d.div('e.pos', stride)}, {d.div(f'l.n - {length} - 1', stride)})"
    out = f"SELECT seq_id, k * {stride} AS off, pos, id FROM (SELECT e.seq_id, e.pos, e.id, {first} AS lo, {last} AS hi FROM encode_ids e JOIN lengths l ON e.seq_id = l.seq_id WHERE l.n > {length}) t {d.series('lo', 'hi', 'k')}"
    if d.p.cover_tail:
        out += f" UNION ALL SELECT e.seq_id, l.n - {length} - 1, e.pos, e.id FROM encode_ids e JOIN lengths l ON e.seq_id = l.seq_id WHERE l.n > {length} AND (l.n - {length} - 1) % {stride} <> 0 AND e.pos >= l.n - {length} - 1"
    return out


@query
def windows(d):
    """Each window's number of tokens, and the sums of its inputs and of its targets."""
    return f"SELECT seq_id, off, count(*) AS n, sum(CASE WHEN pos < off + {int(d.p.length)} THEN id ELSE 0 END) AS x_sum, sum(CASE WHEN pos > off THEN id ELSE 0 END) AS y_sum FROM token_windows GROUP BY seq_id, off"


@query
def window_pairs(d):
    """Each window's inputs x and targets y as texts of ids."""
    length = int(d.p.length)
    return f"SELECT a.seq_id, a.off, a.x, b.y FROM (SELECT seq_id, off, {d.text_of('CAST(id AS STRING)', 'pos')} AS x FROM token_windows WHERE pos < off + {length} GROUP BY seq_id, off) a JOIN (SELECT seq_id, off, {d.text_of('CAST(id AS STRING)', 'pos')} AS y FROM token_windows WHERE pos > off GROUP BY seq_id, off) b ON a.seq_id = b.seq_id AND a.off = b.off"


@view
def note_windows(d):
    """The steps between successive notes of each window of notes: its first note has none."""
    length, stride = int(d.p.length), int(d.p.stride)
    steps = "SELECT piece_id, k - 1 AS pos, pitch - prev AS step, count(*) OVER (PARTITION BY piece_id) AS n FROM ordered"
    first = f"CASE WHEN pos < {length} THEN 0 ELSE {d.div(f'pos - {length} + {stride}', stride)} END"
    last = f"least({d.div('pos - 1', stride)}, greatest(0, {d.div(f'n - {length}', stride)}))"
    return f"SELECT piece_id, w * {stride} AS off, pos, step FROM (SELECT *, {first} AS lo, {last} AS hi FROM ({steps}) s WHERE pos > 0) x {d.series('lo', 'hi', 'w')}"


@query
def window_fingerprint(d):
    """Windows of notes up to transposition, by the intervals between successive notes; a piece of fewer notes is one window."""
    return f"SELECT piece_id, off, md5({d.text_of('CAST(step AS STRING)', 'pos', ',')}) AS k FROM note_windows GROUP BY piece_id, off"


@query
def seed_contexts(d):
    """Contexts to go on from: one window of each piece, drawn by hash among all that lie in it, of equal ones (up to transposition) one; the first by a hash of the piece."""
    seed = int(d.p.seed)
    drawn = f"SELECT piece_id, off, k, row_number() OVER (PARTITION BY piece_id ORDER BY md5('{seed}|' || CAST(piece_id AS STRING) || '|' || CAST(off AS STRING)), off) AS rn FROM window_fingerprint"
    distinct = f"SELECT piece_id, off, row_number() OVER (PARTITION BY k ORDER BY md5('{seed}|' || CAST(piece_id AS STRING)), piece_id) AS twin FROM ({drawn}) w WHERE rn = 1"
    return f"SELECT piece_id, off FROM ({distinct}) x WHERE twin = 1 ORDER BY md5('{seed}|' || CAST(piece_id AS STRING)), piece_id LIMIT {int(d.p.contexts)}"


@query
def seed_context(d):
    """The last `length` ids of each sequence, fewer where it has fewer."""
    return f"SELECT e.seq_id, count(*) AS n, {d.text_of('CAST(e.id AS STRING)', 'e.pos')} AS ids FROM encode_ids e JOIN usable_lengths l ON e.seq_id = l.seq_id WHERE e.pos >= l.n - {int(d.p.length)} GROUP BY e.seq_id"


@query
def target_counts(d):
    return "SELECT v.id, count(e.pos) AS n FROM vocab_ids v LEFT JOIN encode_ids e ON v.id = e.id GROUP BY v.id"


@query
def freq_rank(d):
    """Ids by falling count, ties by id; rnk is the new place of id. The inverse is the same table, read from rnk to id."""
    key = f"lpad(CAST(1000000000000000 - n AS STRING), 16, '0') || lpad(CAST({d.div('id', 65536)} AS STRING), 12, '0')"
    return f"SELECT id, n, rn - 1 AS rnk FROM ({ranked('target_counts', 'id, n', key, 'id')}) x"


@query
def corpus_totals(d):
    return "SELECT t.style, count(DISTINCT t.seq_id) AS sequences, count(*) AS n FROM tokens t GROUP BY t.style"


@query
def batches(d):
    """Training batches: windows of the training split in the order of a hash, batch by batch; the last may be short."""
    chosen = f"(SELECT w.seq_id, w.off, md5('{int(d.p.seed)}|' || CAST(w.seq_id AS STRING) || '|' || CAST(w.off AS STRING)) AS h FROM windows w JOIN doc_split s ON w.seq_id = s.doc_id WHERE s.split = 'train') c"
    return f"SELECT seq_id, off, {d.div('rn - 1', int(d.p.batch))} AS batch FROM ({ranked(chosen, 'seq_id, off', 'substr(h, 1, 3)', 'h, seq_id, off')}) x"


@view
def bigrams(d):
    return "SELECT a, b, count(*) AS n FROM (SELECT seq_id, id AS a, lead(id) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM encode_ids) x WHERE b IS NOT NULL GROUP BY a, b"


@query
def ngram_scores(d):
    """A scorer that needs no network: the log chance of each id after each, of pairs seen, with half a count of add-one unigrams mixed in."""
    return "SELECT x.a AS row_id, x.b AS token_id, round(ln((x.n + 0.5e0 * u.p) / (t.n + 0.5e0)), 9) AS logit FROM bigrams x JOIN (SELECT a, CAST(sum(n) AS DOUBLE) AS n FROM bigrams GROUP BY a) t ON x.a = t.a JOIN (SELECT c.id, (c.n + 1) / CAST(s.n + s.v AS DOUBLE) AS p FROM target_counts c CROSS JOIN (SELECT sum(n) AS n, count(*) AS v FROM target_counts) s) u ON x.b = u.id"
