import json

from notelake.plans import engine
from notelake.sources.midi import midi_bytes, parse, read_midi, write_midi
from notelake.sources.vocabulary import read_vocabulary, vocabulary_json
from notelake.streaming.skips import event_tally, sessions

NOTES = [(60, 0.0, 0.5, 80), (64, 0.5, 0.25, 70), (67, 0.5, 1.0, 127)]


def test_midi_round_trip():
    got = sorted((p, round(a, 3), round(b - a, 3), v) for _, _, p, a, b, v in parse(midi_bytes(NOTES))["notes"])
    assert got == sorted(NOTES)


def test_midi_reader_tolerates_damage(spark, tmp_path):
    (tmp_path / "Jazz").mkdir()
    (tmp_path / "Jazz/a.MID").write_bytes(midi_bytes(NOTES))
    (tmp_path / "b.midi").write_bytes(b"MThd nothing")
    (tmp_path / "c.mid").write_bytes(midi_bytes([]))
    (tmp_path / "d.txt").write_bytes(b"no")
    rows = read_midi(spark, str(tmp_path)).collect()
    assert sorted((r.source, r.style, r.skip_reason) for r in rows if r.skip_reason) == [("b.midi", None, "unreadable"), ("c.mid", None, "no_pitched_notes")]
    assert sorted(r.pitch for r in rows if not r.skip_reason) == [60, 64, 67] and {r.style for r in rows if not r.skip_reason} == {"Jazz"}


def test_midi_writer(spark):
    rows = spark.createDataFrame([(1, p, a, n, v) for p, a, n, v in NOTES], "piece_id long, pitch long, start_sec double, dur_sec double, vel long")
    assert len(parse(bytes(write_midi(rows).first().midi))["notes"]) == 3


def test_vocabulary_file(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"version": 1, "symbols": ["<PAD>", "é"]}))
    v = read_vocabulary(spark, str(path))
    assert {r.symbol: r.id for r in v.collect()} == {"<PAD>": 0, "é": 1}
    assert json.loads(vocabulary_json(v))["symbols"] == ["<PAD>", "é"]


def test_views_take_given_tables(spark):
    """Golden rows: greedy rests, the event codec's round trip, the lowest-note interval, on notes given as a table."""
    notes = spark.createDataFrame([(1, 2, 60, 4, 80), (1, 2, 64, 1, 80), (1, 2, 67, 8, 80), (1, 4, 62, 2, 80), (1, 44, 65, 32, 80)], "piece_id long, st long, pitch long, ds long, vel long")
    assert engine.run(spark, "encode_event", notes=notes).first().symbols == "T2 N60 D4 N64 D1 N67 D8 T2 N62 D2 T16 T16 T8 N65 D32"
    assert engine.run(spark, "encode_note_chord", notes=notes).first().symbols == "<REST:2> 60.64.67 <REST> 62 <REST:16> <REST:16> <REST:7> 65"
    back = {(r.st, r.pitch, r.ds) for r in engine.run(spark, "decode_event", notes=notes).collect()}
    assert back == {(r.st, r.pitch, r.ds) for r in notes.collect()}
    assert {(r.st, r.pitch) for r in engine.run(spark, "decode_note_chord", notes=notes).collect()} == {(r.st, r.pitch) for r in notes.collect()}
    assert engine.run(spark, "codec_vocabulary").count() == 176


def test_vocabulary_order(spark):
    symbols = ["a"] * 5 + ["b"] * 5 + ["c"] * 3 + ["d"] + ["z"] * 9
    tokens = spark.createDataFrame([(1, i, s, "x") for i, s in enumerate(symbols * 4)], "seq_id long, pos long, symbol string, style string")
    got = {r.symbol: r.id for r in engine.run(spark, "vocab_ids", tokens=tokens).collect()}
    assert [got[x] for x in ("<PAD>", "<UNK>", "a", "b", "c", "z")] == [0, 1, 5, 6, 7, 8] and "d" not in got


def test_streams(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet("/root/testdata/sf0.001/event[s].parquet")
    q = event_tally(stream).writeStream.outputMode("complete").format("memory").queryName("tally").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM tally").first()[0] == spark.read.parquet(path).count()
    assert sessions(spark.read.parquet(path)).agg({"n": "sum"}).first()[0] == spark.read.parquet(path).count()


def corpus(tmp_path, n=10):
    for k in range(n):
        folder = tmp_path / "raw" / ("Jazz" if k % 2 else "Blues")
        folder.mkdir(parents=True, exist_ok=True)
        notes = [(48 + (k * 7 + i * (k % 5 + 1)) % 30, 0.25 * i, 0.25, 80) for i in range(48)]
        (folder / f"{k}.mid").write_bytes(midi_bytes(notes))
    (tmp_path / "raw/bad.mid").write_bytes(b"no")
    return str(tmp_path / "raw")


def test_midi_files_run_through_every_stage(spark, tmp_path):
    from notelake.sources.corpus import midi_tables, prepare
    from notelake.sources.processed import load_processed, load_split, raw_fingerprint, read_meta, set_aside, stale

    raw = corpus(tmp_path)
    tables = midi_tables(spark, raw)
    assert {r.skip_reason: r.n for r in engine.run(spark, "skip_reason_tally", **tables).collect()} == {"kept": 10, "unreadable": 1}
    assert engine.run(spark, "notes", **tables).where("st = 0").count() >= 10
    config = {"data": {"val_share": 0.2, "test_share": 0.2}, "augment": {"offset_low": -1, "offset_high": 1}, "encoding": {"scheme": "event", "min_freq": 1}}
    out = prepare(spark, raw, str(tmp_path / "out"), config)
    assert prepare(spark, raw, str(tmp_path / "out"), config) == out
    splits, vocab = load_processed(spark, out)
    meta = read_meta(spark, out)
    assert {s: d.count() for s, d in splits.items()} == meta["sequences"] and meta["sequences"]["train"] == 3 * (10 - 2 - 2)
    assert meta["vocab_size"] == vocab.count() == 5 + 176 and load_split(spark, str(tmp_path / "nowhere"), "val") is None
    assert "PartitionFilters: [isnotnull(split" in load_split(spark, out, "val")._jdf.queryExecution().toString()
    assert stale(spark, out, raw) == []
    (tmp_path / "raw/new.mid").write_bytes(b"x")
    assert len(stale(spark, out, raw)) == 1 and raw_fingerprint(spark, raw)["files"] == 12
    spark.read.parquet(f"{out}/sequences").limit(1).selectExpr("split", "seq_id", "array(100000) as ids", "1 as length").write.mode("append").partitionBy("split").parquet(f"{out}/sequences")
    try:
        load_processed(spark, out)
        raise AssertionError("ids past the vocabulary must not load")
    except ValueError as e:
        assert "different builds" in str(e)
    assert set_aside(spark, out, vocab) is None
    assert set_aside(spark, out, vocab.where("id > 7")).endswith(".old1") and load_processed(spark, out) is None


def test_configurations(tmp_path):
    import pytest

    from notelake.plans.config import laid_over, load_config, parameters, put, value_of

    assert [value_of(x) for x in ("256", "false", "[-3, 3]", "null", "1e-4", "2.5e1", "nan", "a: [")] == [256, False, [-3, 3], None, 1e-4, 25.0, "nan", "a: ["]
    base = {"data": {"grid": 0.25, "list": [1]}, "x": 1}
    got = laid_over(base, {"data": {"grid": 0.5}, "y": {"z": 2}})
    assert got == {"data": {"grid": 0.5, "list": [1]}, "x": 1, "y": {"z": 2}} and base["data"]["grid"] == 0.25 and got["data"]["list"] is not base["data"]["list"]
    put(got, "new.part.name", 3)
    assert got["new"] == {"part": {"name": 3}}
    for bad in ("a..b", "", "x.y"):
        with pytest.raises(ValueError):
            put(got, bad, 1)
    (tmp_path / "a.yaml").write_text("data:\n  grid: 0.25\n  stride: 4\n")
    (tmp_path / "b.yaml").write_text("data:\n  grid: 0.5\n")
    assert parameters(load_config(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), overrides={"model.length": 9})) == {"grid": 0.5, "stride": 4, "length": 9}


def test_command_line(spark, tmp_path, capsys):
    from notelake.__main__ import main

    assert main(["list"]) == 0 and "encode_event" in capsys.readouterr().out
    assert main(["run", "window_counts", "--data", "/root/testdata/sf0.001", "--set", "data.length=4", "--out", str(tmp_path / "w")]) == 0
    assert spark.read.parquet(str(tmp_path / "w")).agg({"windows": "sum"}).first()[0] > 0
    raw = corpus(tmp_path, 4)
    assert main(["evaluate", "--arm", f"jazz={raw}/Jazz", "--arm", f"blues={raw}/Blues", "--reference", raw, "--out", str(tmp_path / "r.md")]) == 0
    lines = (tmp_path / "r.md").read_text().splitlines()
    assert lines[0].startswith("| label | n_pieces |") and [x.split("|")[1:3] for x in lines[2:]] == [[" jazz ", " 2 "], [" blues ", " 2 "]]
