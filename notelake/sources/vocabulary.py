"""Vocabulary files and symbol text files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, id) of a JSON file {"version": 1, "symbols": [...]} or of a bare list; the id is the place."""
    text = spark.read.text(path, wholetext=True).first()[0]
    got = json.loads(text)
    symbols = got["symbols"] if isinstance(got, dict) else got
    return spark.createDataFrame([(s, i) for i, s in enumerate(symbols)], "symbol string, id long")


def vocabulary_json(vocab: DataFrame) -> str:
    """The file's text, for a vocabulary (symbol, id); a vocabulary fits the driver by construction (its size is capped)."""
    return json.dumps({"version": 1, "symbols": [r.symbol for r in vocab.orderBy("id").collect()]}, ensure_ascii=False)


def write_symbols(tokens: DataFrame, path: str) -> None:
    """One text file row per sequence from rows (seq_id, pos, symbol), symbols joined by line ends."""
    rows = tokens.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("s"))
    rows.select(F.concat_ws("\n", F.transform("s", lambda x: x["symbol"])).alias("value")).write.text(path, lineSep="\n\n")
