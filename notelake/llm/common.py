"""Helpers of the training-data operators: shared tables, Arrow batches, held-out folds, grouped streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process (tests)."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="notelake-")
    return _own_dir


def as_table(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notelake-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, equals fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def map_arrow(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema: str, most: int = 8 << 20) -> DataFrame:
    """Applies f to slices of about `most` bytes of each Arrow batch; f gets a dict of Python lists and returns one, of any length."""
    spark_schema = _struct(schema)
    target = _arrow(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a batch is handled in pieces of some MB, so that very long texts do not pile up
            for piece in pieces(b, most):
                out = f({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in target], schema=target)

    return df.mapInArrow(run, spark_schema)


def pieces(b: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes; zero-copy, at least one row each."""
    if not b.num_rows:
        return
    step = max(1, int(b.num_rows * most / max(b.nbytes, 1)))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[tuple, dict[str, list]], Iterator[tuple]], schema: str) -> DataFrame:
    """df dealt by keys and sorted by them; f gets each group's rows as lists and yields output rows.

    Groups stream through a task one after another, so many small groups cost no more than a few large ones; callers
    keep groups bounded. A sorted stream needs no more memory than one group.
    """
    names, spark_schema = df.columns, _struct(schema)
    target = _arrow(spark_schema)
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[list] = [[] for _ in names]
        now: tuple | None = None

        def emit():
            cols = list(zip(*out, strict=True)) if out else [[] for _ in target]
            batch = pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, target, strict=True)], schema=target)
            out.clear()
            return batch

        for b in (p for whole in batches for p in pieces(whole, 2 << 20)):
            cols = [c.to_pylist() for c in b.columns]
            key_rows = list(zip(*(cols[i] for i in at), strict=True))
            start = 0
            for i in range(len(key_rows) + 1):
                if i < len(key_rows) and key_rows[i] == now:
                    continue
                for h, c in zip(held, cols, strict=True):
                    h.extend(c[start:i])
                start = i
                if i < len(key_rows):
                    if now is not None:
                        out.extend(f(now, dict(zip(names, held, strict=True))))
                        held = [[] for _ in names]
                    now = key_rows[i]
            if len(out) >= 4096:
                yield emit()
        if now is not None:
            out.extend(f(now, dict(zip(names, held, strict=True))))
        yield emit()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, spark_schema)
