"""Views by name, compiled with all they depend on into one statement, so that the optimiser sees a query whole."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import Duck, Spark

VIEWS: dict[str, Callable] = {}
QUERIES: list[str] = []
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(f: Callable) -> Callable:
    """Registers a view: a function from a dialect to a SELECT over other views and tables."""
    VIEWS[f.__name__] = f
    return f


def query(f: Callable) -> Callable:
    """A view that is a query of its own."""
    QUERIES.append(f.__name__)
    return view(f)


def compile_view(name: str, dialect, given: frozenset[str] = frozenset()) -> str:
    """The view as one statement; views named in `given` are taken to exist."""
    done: dict[str, str] = {}

    def visit(n: str, path: tuple[str, ...]) -> None:
        if n in done or n in given:
            return
        if n in path:
            raise ValueError(f"{n} depends on itself")
        sql = VIEWS[n](dialect)
        for other in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", re.sub(r"'[^']*'", "", sql)):
            if other in VIEWS and other != n:
                visit(other, (*path, n))
        done[n] = sql

    visit(name, ())
    last = done.pop(name)
    recursive = "RECURSIVE " if any("recursion_" in s for s in (last, *done.values())) else ""
    return (f"WITH {recursive}" + ",\n".join(f"{n} AS ({s})" for n, s in done.items()) + "\n" if done else "") + last


def run(spark: SparkSession, name: str, sf_dir: str | None = None, **given) -> DataFrame:
    """The named query over the tables in sf_dir, or over the given DataFrames: any table or view can be given by name.

    What is no DataFrame is a parameter (plans/parameters.py): run(spark, "windows", path, length=32, stride=4)."""
    if name not in VIEWS:
        raise ValueError(f"no view {name!r}; there are {', '.join(sorted(VIEWS))}")
    inputs = {k: x for k, x in given.items() if isinstance(x, DataFrame)}
    sql = compile_view(name, Spark(**{k: x for k, x in given.items() if k not in inputs}), frozenset(inputs))
    used = set(re.findall(r"\b[a-z_0-9]+\b", sql))
    frames = dict(inputs)
    if sf_dir is not None:
        for t in TABLES:
            if t in used and t not in frames and re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql):
                frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    import uuid

    tag = uuid.uuid4().hex[:8]
    frames = {t: df for t, df in frames.items() if t in used}
    for t, df in frames.items():
        df.createOrReplaceTempView(f"{t}_{tag}")
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b(?!\s*\()", rf"\1\2{t}_{tag}", sql)
    try:
        return spark.sql(sql)
    finally:
        for t in frames:
            spark.catalog.dropTempView(f"{t}_{tag}")


def oracle(name: str, **params) -> str:
    return compile_view(name, Duck(**params))
