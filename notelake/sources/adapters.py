"""Source views: the normal-form tables, taken from the driver's tables."""

from ..plans.engine import view


@view
def raw_notes(d):
    return f"""SELECT user_id AS piece_id, event_id AS note_ord, 21 + {d.prop('props', 'k')} % 88 AS pitch,
        ({d.micros('ts')} % 86400000000) / 3600000000e0 AS start_beats, value / 100e0 AS dur_beats, 1 + event_id % 127 AS vel,
        event_type AS track, event_type = 'error' AS is_drum FROM events"""


@view
def raw_seconds(d):
    """Raw notes with their starts and ends in seconds."""
    return f"""SELECT user_id AS piece_id, event_id AS note_ord, 21 + {d.prop('props', 'k')} % 88 AS pitch,
        {d.micros('ts')} / 1000000e0 AS start_sec, {d.micros('ts')} / 1000000e0 + value / 100e0 AS end_sec, 1 + event_id % 127 AS vel,
        event_type AS track, event_type = 'error' AS is_drum FROM events"""


@view
def pieces(d):
    """skip_reason: why a piece could not be read, null for those that could."""
    return "SELECT DISTINCT user_id AS piece_id, CASE user_id % 3 WHEN 0 THEN 'Classical' WHEN 1 THEN 'Jazz' ELSE 'Blues' END AS style, CAST(NULL AS STRING) AS skip_reason FROM events"


@view
def tempo_changes(d):
    return f"SELECT user_id AS piece_id, {d.micros('ts')} / 1000000e0 AS t_sec, event_id AS ord, 60e0 + {d.prop('props', 'k')} AS bpm FROM events WHERE event_type = 'signup'"


@view
def time_signatures(d):
    return f"SELECT user_id AS piece_id, 2 + {d.prop('props', 'k')} % 3 AS num, 4 AS den FROM events WHERE event_type = 'signup'"


@view
def tokens(d):
    return f"SELECT doc_id AS seq_id, CAST(pos AS BIGINT) AS pos, word AS symbol, lang AS style FROM documents {d.words('text', 'pos', 'word')}"


@view
def item_tokens(d):
    return f"SELECT item_id AS seq_id, CAST(pos AS BIGINT) AS pos, word AS symbol FROM benchmark {d.words('text', 'pos', 'word')}"


@view
def logits(d):
    return f"SELECT vec_id AS row_id, CAST(pos AS BIGINT) AS token_id, CAST(x AS DOUBLE) * 10 AS logit FROM embeddings {d.vector('embedding', 'pos', 'x')}"


@view
def history(d):
    return f"""SELECT row_number() OVER (ORDER BY m) AS epoch, train_loss, val_loss, n FROM (SELECT {d.month('l_shipdate')} AS m,
        round(avg(l_extendedprice) / 10000e0, 6) AS train_loss, round(avg(l_quantity) / 8e0, 6) AS val_loss, count(*) AS n FROM lineitem GROUP BY {d.month('l_shipdate')}) x"""
