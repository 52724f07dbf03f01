"""From folders of MIDI files to the normal-form tables, and from those to a processed corpus or a table of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codec import Encoder
from ..plans import engine
from ..plans.config import parameters
from .midi import read_midi
from .processed import config_hash, is_ready, save_processed, set_aside


def midi_tables(spark: SparkSession, folder: str, **params) -> dict[str, DataFrame]:
    """The tables that every view can be given: raw_seconds, raw_notes (in beats, by the tempo map if tempo_map is asked for), pieces, tempo_changes, time_signatures.

    A piece's id is a hash of its path below folder; files that cannot be read keep their piece, with the reason."""
    rows = read_midi(spark, folder).withColumn("piece_id", F.xxhash64("source"))
    pieces = rows.groupBy("piece_id").agg(F.first("source").alias("source"), F.first("style").alias("style"), F.first("skip_reason").alias("skip_reason"))
    notes = rows.where("skip_reason is null")
    heads = rows.groupBy("piece_id").agg(F.first("tempos").alias("tempos"), F.first("signatures").alias("signatures"))
    raw = notes.select("piece_id", F.col("track").cast("string").alias("track"), "is_drum", "pitch", "start_sec", "end_sec", "vel")
    raw = raw.withColumn("note_ord", F.row_number().over(_by_piece()).cast("long"))
    out = {
        "raw_seconds": raw,
        "pieces": pieces,
        "tempo_changes": heads.select("piece_id", F.posexplode("tempos").alias("ord", "t")).select("piece_id", F.col("ord").cast("long").alias("ord"), "t.t_sec", "t.bpm"),
        "time_signatures": heads.select("piece_id", F.explode("signatures").alias("s")).select("piece_id", "s.num", "s.den"),
    }
    tempo = {"tempo_map": params["tempo_map"]} if "tempo_map" in params else {}
    return out | {"raw_notes": engine.run(spark, "notes_in_beats", **out, **tempo)}


def _by_piece():
    from pyspark.sql import Window

    return Window.partitionBy("piece_id").orderBy("start_sec", "pitch", "track", "end_sec", "vel")


def prepare(spark: SparkSession, folder: str, out: str, config: dict | None = None) -> str:
    """MIDI files to ids: clean notes, split, transpositions of the training split, symbols, a vocabulary of the training split, ids. The folder written.

    What stands there complete for this configuration is used again; another vocabulary's corpus is set aside."""
    config = config or {}
    target = f"{out.rstrip('/')}/{config_hash(config)}"
    if is_ready(spark, target, config):
        return target
    params = parameters(config)

    def stage(df: DataFrame, name: str) -> DataFrame:
        """Written and read again: later stages read it many times, and no plan grows."""
        path = f"{out.rstrip('/')}/stages-{config_hash(config)}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    scheme = (config.get("encoding") or {}).get("scheme", "event")
    given = midi_tables(spark, folder, **params)
    given = {k: stage(x, k) for k, x in given.items() if k != "raw_seconds"}
    notes = stage(engine.run(spark, "kept_notes", **given, **params), "notes")
    split = stage(engine.run(spark, "piece_split", notes=notes, pieces=notes.select("piece_id").distinct(), **params), "split")
    keys = stage(engine.run(spark, "keys", notes=notes, **params).join(split, "piece_id").where("k = 0 or split = 'train'"), "keys")
    moved = notes.join(keys, "piece_id").select(F.xxhash64("piece_id", "k").alias("piece_id"), "st", (F.col("pitch") + F.col("k")).alias("pitch"), "ds", "vel")
    codec = Encoder(scheme, **{k: v for k, v in params.items()})
    seqs = keys.select(F.xxhash64("piece_id", "k").alias("seq_id"), "split")
    symbols = stage(codec.encode(moved).withColumnRenamed("piece_id", "seq_id").join(seqs, "seq_id"), "symbols")
    tokens = symbols.select("seq_id", "pos", "symbol", F.lit(None).cast("string").alias("style"))
    docs = seqs.select(F.col("seq_id").alias("doc_id"), F.lit("").alias("text"), "split")
    vocab = stage(engine.run(spark, "train_vocab", tokens=tokens, doc_split=docs, declared=codec.vocabulary(spark), **params), "vocab")
    ids = engine.run(spark, "encode_ids", tokens=tokens, vocab_ids=vocab).join(seqs, "seq_id")
    set_aside(spark, target, vocab)
    return save_processed(ids.select("split", "seq_id", "pos", "id"), vocab, out, config, folder)


def evaluate(spark: SparkSession, arms: dict[str, str], reference: str | None = None, **params):
    """Rows of metrics, one for each arm (label to folder of MIDI files), held against the reference folder, or against all arms together.

    Arms are read without a smallest number of events and whatever their time signatures."""
    loose = params | {"min_events": 1, "signatures": ()}
    notes = labels = None
    for label, folder in arms.items():
        got = engine.run(spark, "kept_notes", **midi_tables(spark, folder, **loose), **loose).withColumn("piece_id", F.xxhash64("piece_id", F.lit(label)))
        own = got.select("piece_id").distinct().withColumn("label", F.lit(label))
        notes, labels = (got, own) if notes is None else (notes.unionByName(got), labels.unionByName(own))
    ref = labels.select("piece_id")
    if reference:
        got = engine.run(spark, "kept_notes", **midi_tables(spark, reference, **params), **params).withColumn("piece_id", F.xxhash64("piece_id", F.lit("reference"), F.lit(1)))
        notes, ref = notes.unionByName(got), got.select("piece_id").distinct()
    notes = notes.persist()  # every metric reads them; a lost part is read from the files again
    pieces = notes.select("piece_id").distinct().withColumn("style", F.lit(None).cast("string")).withColumn("skip_reason", F.lit(None).cast("string"))
    rows = engine.run(spark, "evaluate_report", notes=notes, pieces=pieces, labelled=labels, reference_pieces=ref, **params)
    try:
        return sorted(rows.where("label <> 'all'").collect(), key=lambda r: list(arms).index(r.label))
    finally:
        notes.unpersist()
