"""Processed corpora: sequences of ids by split, their vocabulary, and what they were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocabulary import read_vocabulary, vocabulary_json

VERSION = 1
SPLITS = ("train", "val", "test")
SECTIONS = ("data", "augment", "encoding")


def config_hash(config: dict, sections: tuple[str, ...] = SECTIONS) -> str:
    """Ten hexadecimal digits that change when any of the sections does."""
    chosen = {s: config[s] for s in sections if s in config}
    return hashlib.sha1(json.dumps(chosen, sort_keys=True, default=str).encode()).hexdigest()[:10]


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return None
    return row[0] if row else None


def raw_fingerprint(spark: SparkSession, folder: str) -> dict | None:
    """What the files of a folder are: their number and a digest of their paths, sizes and times. Contents are not read; null without files."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    except AnalysisException:
        return None
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    h = F.xxhash64(F.element_at(F.split("path", root + "/", 2), -1), "length", F.col("modificationTime").cast("double"))
    n, total, both = files.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return {"files": n, "sha1": hashlib.sha1(f"{n} {total} {both}".encode()).hexdigest()} if n else None


def save_processed(ids: DataFrame, vocab: DataFrame, folder: str, config: dict | None = None, raw: str | None = None) -> str:
    """Writes rows (split, seq_id, pos, id) as one array for each sequence, a directory for each split; with the vocabulary and a note of what it was made from.

    The folder's last part is the hash of the configuration, so another configuration never reads these. Returns that folder."""
    spark, config = ids.sparkSession, config or {}
    out = f"{folder.rstrip('/')}/{config_hash(config)}"
    rows = ids.groupBy("split", "seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("int")).alias("ids"))
    rows.withColumn("length", F.size("ids")).write.mode("overwrite").partitionBy("split").parquet(f"{out}/sequences")
    counts = {r.split: r.n for r in spark.read.parquet(f"{out}/sequences").groupBy("split").agg(F.count("*").alias("n")).collect()}
    _write_text(spark, vocabulary_json(vocab), f"{out}/vocab.json")
    meta = {"config_hash": config_hash(config), "sections": [s for s in SECTIONS if s in config], "encoding": config.get("encoding"), "vocab_size": vocab.count(), "sequences": {s: counts.get(s, 0) for s in SPLITS}, "pipeline_version": VERSION, "raw_fingerprint": raw_fingerprint(spark, raw) if raw else None}
    _write_text(spark, json.dumps(meta, default=str), f"{out}/meta.json")  # last: a folder without it is not complete
    return out


def read_meta(spark: SparkSession, folder: str) -> dict | None:
    text = _read_text(spark, f"{folder}/meta.json")
    return json.loads(text) if text else None


def is_ready(spark: SparkSession, folder: str, config: dict | None = None) -> bool:
    """Whether a complete corpus, of this configuration if one is given, stands in the folder."""
    meta = read_meta(spark, folder)
    return meta is not None and (config is None or meta["config_hash"] == config_hash(config))


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame | None:
    """(seq_id, ids, length) of one split; the files of the others are not touched. Null where nothing complete stands."""
    if split not in SPLITS:
        raise ValueError(f"no split {split!r}; there are {', '.join(SPLITS)}")
    if read_meta(spark, folder) is None:
        return None
    return spark.read.parquet(f"{folder}/sequences").where(F.col("split") == split).select("seq_id", "ids", "length")


def load_processed(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame] | None:
    """The splits and the vocabulary, or null where nothing complete stands. Ids that the vocabulary does not have are an error."""
    if (meta := read_meta(spark, folder)) is None:
        return None
    low, high = spark.read.parquet(f"{folder}/sequences").select(F.array_min("ids").alias("a"), F.array_max("ids").alias("b")).agg(F.min("a"), F.max("b")).first()
    if low is not None and (low < 0 or high >= meta["vocab_size"]):
        raise ValueError(f"{folder}: ids from {low} to {high}, but the vocabulary has {meta['vocab_size']} symbols: they are of different builds")
    return {s: load_split(spark, folder, s) for s in SPLITS}, read_vocabulary(spark, f"{folder}/vocab.json")


def stale(spark: SparkSession, folder: str, raw: str | None = None) -> list[str]:
    """Why a corpus may not match the code or the files it was made from; empty if nothing speaks against it."""
    meta, out = read_meta(spark, folder), []
    if meta is None:
        return ["nothing complete stands there"]
    if meta.get("pipeline_version", 1) < VERSION:
        out.append(f"made by version {meta.get('pipeline_version', 1)}, this is {VERSION}")
    if raw and meta.get("raw_fingerprint") and (now := raw_fingerprint(spark, raw)) != meta["raw_fingerprint"]:
        out.append(f"the files have changed: {meta['raw_fingerprint']['files']} then, {now['files'] if now else 0} now")
    return out


def set_aside(spark: SparkSession, folder: str, vocab: DataFrame) -> str | None:
    """Renames a corpus whose vocabulary is another one, so that it is not overwritten; the new name, or null where nothing is in the way."""
    text = _read_text(spark, f"{folder}/vocab.json")
    if text is None or json.loads(text)["symbols"] == json.loads(vocabulary_json(vocab))["symbols"]:
        return None
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(folder)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    k = 1
    while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}.old{k}")):
        k += 1
    fs.rename(old, jvm.org.apache.hadoop.fs.Path(f"{folder}.old{k}"))
    return f"{folder}.old{k}"
