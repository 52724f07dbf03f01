"""Registry of queries and their SQL twins."""

from functools import partial

from .operators import codec, corpus, metrics, notes, sampling, timing  # noqa: F401
from .plans import engine
from .sources import adapters  # noqa: F401


def _query(spark, sf_dir, name):
    return engine.run(spark, name, sf_dir)


QUERIES = {n: partial(_query, name=n) for n in engine.QUERIES}
ORACLE_SQL = {n: engine.oracle(n) for n in engine.QUERIES}
