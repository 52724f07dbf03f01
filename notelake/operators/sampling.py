"""Filters and draws over logits: bans, temperature, top-k, top-p, softmax, in that order."""

from ..plans.engine import query, view


@view
def banned(d):
    """Ids never to be drawn: reserved ones, unless another table (token_id) is given."""
    unk = "" if d.p.allow_unk else ", '<UNK>'"
    return f"SELECT id AS token_id FROM reserved WHERE symbol IN ('<PAD>', '<BOS>', '<EOS>'{unk})"


@view
def judged(d):
    """All logits; bad ones are banned, or no number."""
    return "SELECT l.row_id, l.token_id, l.logit, b.token_id IS NOT NULL OR l.logit IS NULL OR isnan(l.logit) AS bad FROM logits l LEFT JOIN banned b ON l.token_id = b.token_id"


@view
def allowed(d):
    return "SELECT row_id, token_id, logit FROM judged WHERE NOT bad"


@query
def ban_tokens(d):
    return "SELECT row_id, count(*) AS n, round(max(logit), 6) AS top FROM allowed GROUP BY row_id"


@query
def greedy(d):
    """The largest logit that is neither banned nor no number, of equals the first; the first token of a row that has none."""
    return "SELECT row_id, token_id FROM (SELECT row_id, token_id, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN bad THEN 1 ELSE 0 END, CASE WHEN bad THEN 0e0 ELSE logit END DESC, token_id) AS rn FROM judged) x WHERE rn = 1"


@view
def cooled(d):
    t = float(d.p.temperature or 0)
    return f"SELECT row_id, token_id, logit / {d.num(t)} AS logit FROM allowed" if t > 0 else "SELECT row_id, token_id, logit FROM allowed"


def _softmax(source):
    """Chances, from logits less the row's largest; a row whose largest is infinite, or that has no finite one, falls back to its first largest."""
    most = f"SELECT *, max(logit) OVER (PARTITION BY row_id) AS m, row_number() OVER (PARTITION BY row_id ORDER BY logit DESC, token_id) AS rn FROM {source}"
    # the largest is replaced where it is not finite, so that no difference of infinities is taken
    safe = f"SELECT row_id, token_id, logit, rn, abs(m) < 1e300 AS ok, CASE WHEN abs(m) < 1e300 THEN exp(greatest(-745e0, logit - m)) ELSE 0e0 END * CASE WHEN logit > -1e300 THEN 1e0 ELSE 0e0 END AS e FROM ({most}) x"
    return f"SELECT row_id, token_id, logit, CASE WHEN ok THEN e / sum(e) OVER (PARTITION BY row_id) WHEN rn = 1 THEN 1e0 ELSE 0e0 END AS p FROM ({safe}) y"


@view
def cooled_p(d):
    return _softmax("cooled")


@query
def softmax_temperature(d):
    return "SELECT row_id, token_id, round(p, 9) AS p FROM cooled_p"


@view
def shortlist(d):
    """Logits that reach the k-th largest; ties stay; k of 0 keeps all."""
    k = int(d.p.top_k or 0)
    return f"SELECT row_id, token_id, logit FROM (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY logit DESC) AS r FROM cooled) x WHERE r <= {k}" if k > 0 else "SELECT row_id, token_id, logit FROM cooled"


@query
def top_k(d):
    return "SELECT row_id, token_id, round(logit, 6) AS logit FROM shortlist"


def _nucleus(d, chances):
    """Tokens before which less than p of the mass stands; the first always stays; p of 0 or 1 keeps all."""
    p = float(d.p.top_p or 0)
    if not 0 < p < 1:
        return f"SELECT row_id, token_id, logit, p FROM {chances}"
    return f"SELECT row_id, token_id, logit, p FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY row_id ORDER BY logit DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {chances}) x WHERE round(before, 12) < {d.num(p)}"


@query
def top_p(d):
    return f"SELECT row_id, token_id, round(p, 9) AS p FROM ({_nucleus(d, 'cooled_p')}) n"


@view
def final_chances(d):
    """Chances after temperature, top-k and top-p."""
    first = _softmax("shortlist")
    return _softmax(f"({_nucleus(d, f'({first}) c')}) n")


@query
def sample(d):
    """One draw for each row, by the largest log chance plus noise, which is a hash of seed, row and token; at temperature 0 the greedy choice."""
    if not float(d.p.temperature or 0) > 0:
        return "SELECT row_id, token_id FROM greedy"
    u = d.hash_unit(str(int(d.p.draw_seed)), "row_id", "token_id")
    drawn = f"SELECT row_id, token_id FROM (SELECT row_id, token_id, row_number() OVER (PARTITION BY row_id ORDER BY round(ln(p) - ln(-ln({u})), 9) DESC, token_id) AS rn FROM final_chances WHERE p > 0) x WHERE rn = 1"
    return f"SELECT g.row_id, coalesce(s.token_id, g.token_id) AS token_id FROM greedy g LEFT JOIN ({drawn}) s ON g.row_id = s.row_id"


@query
def perplexity(d):
    """Of the token with the rank of the row's id among the allowed ones."""
    return f"SELECT round(exp(sum(nll) / count(*)), 6) AS perplexity, count(*) AS n FROM (SELECT -ln(p) AS nll FROM ({_softmax('allowed')}) s WHERE token_id = 4 + row_id % 60) x"


def derived_seed(seed: int, index: int) -> int:
    """The seed of the index-th sample of a run."""
    return (int(seed) + int(index)) % ((1 << 63) - 1)


def generate(scorer, contexts, steps: int, path: str, **params):
    """(row_id, pos, token_id): `steps` tokens after each context (row_id, pos, token_id), drawn one after another.

    scorer(contexts) gives logits (row_id, token_id, logit) for the next token of each row. Each step is one batch over all
    rows; every eighth is written to the folder `path`, so that no plan grows with the number of steps."""
    from pyspark.sql import functions as F

    from ..plans import engine

    spark, seed = contexts.sparkSession, int(params.pop("draw_seed", 7))
    now = contexts.select("row_id", "pos", "token_id")
    for step in range(steps):
        drawn = engine.run(spark, "sample", logits=scorer(now), draw_seed=derived_seed(seed, step), **params)
        ends = now.groupBy("row_id").agg((F.max("pos") + 1).alias("pos"))
        new = drawn.join(ends, "row_id").select("row_id", "pos", "token_id")
        now = now.unionByName(new)
        if step % 8 == 7 or step == steps - 1:
            now.write.mode("overwrite").parquet(f"{path}/step-{step:06d}")
            now = spark.read.parquet(f"{path}/step-{step:06d}")
    first = contexts.groupBy("row_id").agg(F.max("pos").alias("last"))
    return now.join(first, "row_id").where("pos > last").select("row_id", "pos", "token_id")
