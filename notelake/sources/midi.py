"""Standard MIDI files: a reader into the normal-form tables, and a writer."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE_SCHEMA = "source string, style string, skip_reason string, track long, is_drum boolean, pitch long, start_sec double, end_sec double, vel long, tempos array<struct<t_sec:double,bpm:double>>, signatures array<struct<num:int,den:int>>"


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        b = data[at]
        at += 1
        value = value << 7 | b & 127
        if b < 128:
            return value, at


def parse(data: bytes) -> dict:
    """Notes in seconds, tempo changes and time signatures of a file. Raises ValueError or IndexError on damaged input."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, _, tracks, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000 or not division:
        raise ValueError("only ticks per quarter note are read")
    at, tempos, signatures, raw = 8 + size, [(0, 500000)], [], []
    for track in range(tracks):
        if data[at : at + 4] != b"MTrk":
            raise ValueError("no track")
        end = at + 8 + struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, tick, status, sounding = at + 8, 0, 0, {}
        while at < end:
            step, at = _number(data, at)
            tick += step
            if data[at] >= 128:
                status = data[at]
                at += 1
            kind, channel = status >> 4, status & 15
            if status == 0xFF:
                meta = data[at]
                n, at = _number(data, at + 1)
                if meta == 0x51 and n == 3:
                    tempos.append((tick, int.from_bytes(data[at : at + 3], "big")))
                elif meta == 0x58 and n >= 2:
                    signatures.append((data[at], 1 << data[at + 1]))
                at += n
            elif status in (0xF0, 0xF7):
                n, at = _number(data, at)
                at += n
            elif kind in (8, 9):
                pitch, vel = data[at], data[at + 1]
                at += 2
                if kind == 9 and vel:
                    sounding.setdefault((channel, pitch), []).append((tick, vel))
                elif sounding.get((channel, pitch)):
                    began, loud = sounding[channel, pitch].pop(0)
                    raw.append((track, channel == 9, pitch, began, tick, loud))
            else:
                at += 1 if kind in (12, 13) else 2
        at = end
    tempos = sorted({t: u for t, u in sorted(tempos)}.items())
    marks, seconds = [], 0.0
    for i, (t, u) in enumerate(tempos):
        if i:
            seconds += (t - tempos[i - 1][0]) * tempos[i - 1][1] / division / 1e6
        marks.append((t, seconds, u))

    def clock(tick: int) -> float:
        t, s, u = next(m for m in reversed(marks) if m[0] <= tick)
        return s + (tick - t) * u / division / 1e6

    return {"notes": [(k, drum, p, clock(a), clock(b), v) for k, drum, p, a, b, v in raw], "tempos": [(s, 6e7 / u) for _, s, u in marks if u], "signatures": signatures}


def read_midi(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each note of each .mid or .midi file below folder (suffix in any case), or one row with skip_reason.

    The style is the first directory below folder, null at its root. Damaged files give 'unreadable', files without notes
    'no_pitched_notes'; nothing raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.lower("path").rlike(r"\.midi?$")).select("path", "content")
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")

    def run(frames):
        import pandas as pd

        names = [x.strip().split()[0] for x in ("source", "style", "skip_reason", "track", "is_drum", "pitch", "start_sec", "end_sec", "vel", "tempos", "signatures")]
        for f in frames:
            out = []
            for path, content in zip(f.path, f.content, strict=True):
                rel = path.split(root + "/", 1)[-1]
                style = rel.split("/")[0] if "/" in rel else None
                try:
                    got = parse(bytes(content))
                except (ValueError, IndexError, struct.error, StopIteration):
                    out.append((rel, style, "unreadable", None, None, None, None, None, None, None, None))
                    continue
                tempos = [{"t_sec": a, "bpm": b} for a, b in got["tempos"]]
                signs = [{"num": a, "den": b} for a, b in got["signatures"]]
                out += [(rel, style, None, *n, tempos, signs) for n in got["notes"]] or [(rel, style, "no_pitched_notes", None, None, None, None, None, None, tempos, signs)]
            yield pd.DataFrame(out, columns=names).astype({"track": "Int64", "pitch": "Int64", "vel": "Int64", "is_drum": "boolean"})

    return files.mapInPandas(run, NOTE_SCHEMA)


def midi_bytes(notes: list[tuple[int, float, float, int]], bpm: float = 120.0, division: int = 480) -> bytes:
    """A one-track file of (pitch, start in seconds, duration in seconds, velocity)."""
    per_second = division * bpm / 60
    marks = []
    for pitch, start, length, vel in notes:
        pitch, vel = min(127, max(0, pitch)), min(127, max(1, vel))
        begin = round(max(0.0, start) * per_second)
        marks += [(begin, 1, bytes([0x90, pitch, vel])), (max(begin + 1, round((max(0.0, start) + max(0.001, length)) * per_second)), 0, bytes([0x80, pitch, 0]))]
    body, last = b"\x00\xff\x51\x03" + round(6e7 / bpm).to_bytes(3, "big"), 0
    for tick, _, event in sorted(marks):
        step, digits = tick - last, []
        while True:
            digits.append(step & 127 | (128 if digits else 0))
            step >>= 7
            if not step:
                break
        body += bytes(reversed(digits)) + event
        last = tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(body)) + body


def write_midi(notes: DataFrame) -> DataFrame:
    """(piece_id, midi) from rows (piece_id, pitch, start_sec, dur_sec, vel), a piece in one task."""
    rows = notes.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "pitch", "dur_sec", "vel"))).alias("n"))

    @F.pandas_udf("binary")
    def encode(pieces):
        import pandas as pd

        return pd.Series([midi_bytes([(x["pitch"], x["start_sec"], x["dur_sec"], x["vel"]) for x in n]) for n in pieces])

    return rows.select("piece_id", encode("n").alias("midi"))
