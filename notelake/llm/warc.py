"""Operator 8: WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, pieces

#: Fixed values of the formats: Zstandard's seekable format, WARC.
SKIPPABLE, SEEKABLE, INDEXED = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
VERSION = b"WARC/1.1"
FRAME = 64 << 10  # bytes of records to a frame, before compression
BUNDLE = 1 << 20  # bytes of frames to a bundle


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % str(page_id).encode()


def record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, told: str | None = None, size: int | None = None) -> bytes:
    """One WARC record: a response with its HTTP head and payload, or, with refers_to, a revisit, of which only the head, the payload's digest and its size are kept."""
    told, size = (digest(payload), len(payload)) if payload is not None else (told, size)
    kind = b"response" if refers_to is None else b"revisit"
    head = [VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: " + record_id(page_id), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + (url or "").encode("utf-8", "replace").replace(b"\r", b"%0D").replace(b"\n", b"%0A"), b"WARC-Payload-Digest: sha1:" + told.encode(), b"X-Payload-Length: %d" % size, b"Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload if refers_to is None else b"")
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and payload, without the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = {k.decode().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


class BundleWriter:
    """Gathers records into independent frames. close() appends a skippable frame that maps record ids to (frame, offset, length), then the seek table, and returns the archive."""

    def __init__(self, level: int = 3):
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[bytes, int]] = []
        self.open: list[bytes] = []
        self.filled = self.size = 0
        self.index: list[tuple[int | None, int, int, int]] = []

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.filled, len(raw)))
        self.open.append(raw)
        self.filled += len(raw)
        if self.filled >= FRAME:
            self._seal()

    def _seal(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.frames.append((packed, self.filled))
            self.size += len(packed)
            self.open, self.filled = [], 0

    def close(self) -> bytes:
        self._seal()
        rows = sorted(self.index, key=lambda x: (x[0] is None, x[0] or 0))
        packed = self.zip.compress(b"".join(ENTRY.pack(i is not None, i or 0, *at) for i, *at in rows))
        places = struct.pack("<II", INDEXED, len(packed) + 4) + packed + struct.pack("<I", len(packed))
        # the index counts as a frame without content, so that the table's sums lead past it
        entries = b"".join(struct.pack("<II", len(p), n) for p, n in [*self.frames, (places, 0)])
        footer = struct.pack("<IBI", len(self.frames) + 1, 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(p for p, _ in self.frames) + places + table


ENTRY = struct.Struct("<BqIIQ")  # whether there is an id, the id, frame, offset, length


class BundleReader:
    """Random access by the seek table in the footer: one frame is decompressed for a record. read_at(start, size) gives bytes of the archive, which need not be in memory."""

    def __init__(self, archive: bytes | None = None, read_at=None, total: int | None = None):
        self.read_at = read_at or (lambda start, size: archive[start : start + size])
        total = len(archive) if total is None else total
        count, _, magic = struct.unpack("<IBI", self.read_at(total - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entries = self.read_at(total - 9 - 8 * count, 8 * count)
        self.places, at = [], 0
        for i in range(count):
            packed, size = struct.unpack_from("<II", entries, 8 * i)
            self.places.append((at, packed, size))
            at += packed
        self.unzip = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")
        self.known: list[tuple[int | None, int, int, int]] | None = None

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            at, packed, size = self.places[i]
            self.last = (i, self.unzip.decompress(self.read_at(at, packed), max_output_size=size))
        return self.last[1]

    def index(self) -> list[tuple[int | None, int, int, int]]:
        """(id, frame, offset, length) of all records, ids in order, null last."""
        if self.known is None:
            at, packed, _ = self.places[-1]
            places = self.read_at(at, packed)
            raw = self.unzip.decompress(places[8:-4], max_output_size=1 << 31)
            self.known = [(i if held else None, *rest) for held, i, *rest in ENTRY.iter_unpack(raw)]
        return self.known

    def read(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def find(self, page_id: int) -> list[bytes]:
        """The records of an id, by the index and the seek table alone: no other frame is read."""
        rows = self.index()
        k = bisect_left(rows, (False, page_id), key=lambda x: (x[0] is None, x[0] or 0))
        out = []
        while k < len(rows) and rows[k][0] == page_id:
            out.append(self.read(*rows[k][1:]))
            k += 1
        return out


BUNDLES = pa.schema([("bundle", pa.string()), ("archive", pa.binary()), ("ids", pa.list_(pa.int64()))])


def write_bundles(pages: DataFrame) -> DataFrame:
    """Archives of all pages, a row each: (bundle, archive, ids), in a table in the shared folder; ids: of the records within.

    Of records with equal payloads that with the largest page_id is the response and the others revisit it. Digests alone are
    grouped; revisits are written from them, without their html, and the html of responses is joined by page, so however many
    pages share a payload, theirs do not meet. Null html is empty; a repeated row of the response is a response again; pages whose
    ids are all null are responses; an empty table gives no bundle.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    heads = p.select("page_id", "url", "sha", F.octet_length("html").cast("long").alias("size"))
    first = heads.groupBy("sha").agg(F.max("page_id").alias("first"))
    marked = as_table(heads.join(first, "sha").withColumn("revisit", F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())), "digests")
    none = F.lit(None).cast("string")
    revisits = marked.where("revisit").select("page_id", "url", none.alias("html"), "first", "sha", "size")
    chosen = marked.where("not revisit").select(F.col("page_id").alias("i"), F.col("sha").alias("s")).distinct()
    responses = p.join(chosen, p["page_id"].eqNullSafe(chosen["i"]) & (p["sha"] == chosen["s"]), "left_semi")
    both = revisits.unionByName(responses.select("page_id", "url", "html", F.lit(None).cast("long").alias("first"), "sha", F.lit(0).cast("long").alias("size")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, w = TaskContext.get().partitionId(), 0, BundleWriter()

        def sealed():
            rows = [[f"{part:06d}-{n:06d}"], [w.close()], [[x[0] for x in w.index]]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, BUNDLES, strict=True)], schema=BUNDLES)

        for b in batches:
            for x in pieces(b):
                for page_id, url, html, one, sha, size in zip(*(c.to_pylist() for c in x.columns), strict=True):
                    if html is None:
                        w.add(page_id, record(page_id, url, None, one, base64.b32encode(bytes.fromhex(sha)).decode(), size))
                    else:
                        w.add(page_id, record(page_id, url, html.encode("utf-8", "replace"), None))
                    if w.size >= BUNDLE:
                        yield sealed()
                        n, w = n + 1, BundleWriter()
        if w.index:
            yield sealed()

    return as_table(both.mapInArrow(pack, "bundle string, archive binary, ids array<long>"), "warc")


#: what is known of a record once it is read
FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def fields(page_id: int | None, raw: bytes) -> tuple[tuple, bytes]:
    """What a record's headers say of it, and its payload, checked against the digest."""
    head, payload = parse(raw)
    told, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    if kind == "response" and (digest(payload) != told or len(payload) != int(head["x-payload-length"])):
        raise ValueError(f"record {page_id} is damaged")
    refers = head.get("warc-refers-to")
    return (page_id, int(head["x-payload-length"]), told, kind, int(refers[len("<urn:page:") : -1]) if refers else None), payload


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Per record of the archives (column archive): (page_id, payload_bytes, payload_digest, record_type, refers_to), as the archive's own index and headers say.

    A response's payload is checked against its digest. Other columns are not read; an empty table gives an empty result."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                reader = BundleReader(b.column(0)[i].as_py())
                rows = [fields(page_id, reader.read(*at))[0] for page_id, *at in sorted(reader.index(), key=lambda x: x[1:3])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)

    return bundles.select("archive").mapInArrow(unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def find_records(bundles: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of the records with the wanted ids; a revisit's payload is null.

    The table of bundles tells which of them hold a wanted id; of their frames only those that the index names are decompressed. Null and repeated ids are asked for once or not at all."""
    ids = wanted.select(F.col(id_col).cast("long").alias("i")).where("i is not null").distinct()
    hits = bundles.select("bundle", F.explode("ids").alias("i")).join(ids, "i").groupBy("bundle").agg(F.collect_set("i").alias("wanted"))
    schema = pa.schema([*FIELDS, ("payload", pa.binary())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                reader, rows = BundleReader(b.column(0)[i].as_py()), []
                for page_id in b.column(1)[i].as_py():
                    for raw in reader.find(page_id):
                        known, payload = fields(page_id, raw)
                        rows.append((*known, payload if known[3] == "response" else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return bundles.select("bundle", "archive").join(hits, "bundle").select("archive", "wanted").mapInArrow(look, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each archive, index and seek table included, as a .warc.zst file into a folder that all executors share; (bundle, path, bytes) of each."""

    def write(batches):
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for i, name in enumerate(names):
                data = b.column(1)[i].as_py()
                with target.open_output_stream(f"{base}/{name}.warc.zst", compression=None) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([f"{folder}/{n}.warc.zst" for n in names]), pa.array(sizes, pa.int64())], ["bundle", "path", "bytes"])

    return bundles.select("bundle", "archive").mapInArrow(write, "bundle string, path string, bytes long")
