"""WARC archives as seekable Zstandard bundles.

Records go to bundles by a hash of their id. In a bundle, runs of records form independent frames of about FRAME_BYTES; a
skippable frame before them maps record ids to (frame, offset inside the frame, length), and the file ends with the
seekable format's seek table, so one record is read by decompressing one frame. `write_index` gathers these maps into one
table for the archive, sorted by id: a lookup reads that table's rows of the id and the one bundle they name. Of records with
equal payloads that with the largest id is the response, the others are revisits that name it.

Bundles are binary rows written by Spark's own text writer (one row a file; the constant end of the seek table is the line
separator), so they reach any store Spark can write, under its commit protocol, and are read with the binaryFile source.

Cases: a null payload is empty; a very long payload is a frame of its own; null ids are allowed and rank below all others; of repeated rows (id and payload) the first
is the response and the rest revisit it; an empty table gives no bundle and an empty result; only the id, url and payload
are read. Repeated rows of one id share a bundle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import LIST_BYTES, octets, written
from loomline.operators.components import shared_dir

BUNDLE_BYTES = 8 << 20
FRAME_BYTES = 256 << 10
BUNDLES_A_TASK = 8
#: Records with one payload that a task may get from a shuffle by payload.
HOT_COPIES = 4096
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: How every bundle ends: the descriptor (no checksums) and the magic number, little-endian.
TAIL = b"\x00" + struct.pack("<I", SEEK_MAGIC)
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def urn(record_id) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def of_urn(text: str) -> int | None:
    name = text.rpartition(":")[2].rstrip(">")
    return int(name) if name else None


def record(record_id, url: str | None, payload: bytes, refers_to: tuple | None) -> bytes:
    """One WARC/1.1 record; refers_to: the response's id in a tuple, None for a response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP if refers_to else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {urn(record_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to[0])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def bundle(records: list[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES) -> bytes:
    """A seekable bundle without its TAIL."""
    press = zstandard.ZstdCompressor(level=3)
    frames: list[tuple[bytes, int]] = []
    index, held = [], []
    size = 0
    for i, (record_id, raw) in enumerate(records):
        index.append((record_id, len(frames) + 1, size, len(raw)))  # the index itself is frame 0
        held.append(raw)
        size += len(raw)
        if size >= frame_bytes or i == len(records) - 1:
            frames.append((press.compress(b"".join(held)), size))
            held, size = [], 0
    table = zstandard.ZstdCompressor(level=3).compress(json.dumps(index).encode())
    first = struct.pack("<II", SKIPPABLE_INDEX, len(table)) + table
    entries = b"".join(struct.pack("<II", len(c), n) for c, n in [(first, 0), *frames])
    seek = struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries + struct.pack("<I", len(frames) + 1)
    return first + b"".join(c for c, _ in frames) + seek


class Bundle:
    """Random access to a bundle's records through its seek table and index."""

    def __init__(self, content: bytes):
        n, _, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("not a seekable bundle")
        self.content, self.starts, at = content, [], 0
        entries = content[-9 - 8 * n : -9]
        for k in range(n):
            c, _ = struct.unpack_from("<II", entries, 8 * k)
            self.starts.append((at, c))
            at += c
        a, c = self.starts[0]
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(content[a + 8 : a + c]))
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            a, c = self.starts[k]
            self.last = (k, zstandard.ZstdDecompressor().decompress(self.content[a : a + c]))
        return self.last[1]

    def at(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame)[offset : offset + length])

    def find(self, record_id) -> list[tuple[dict[str, str], bytes]]:
        return [self.at(*place) for i, *place in self.index if i == record_id]


def home(record_id: Column, digest: Column, n: int) -> Column:
    """The bundle of a record; records without an id are dealt by payload."""
    return F.pmod(F.coalesce(F.xxhash64(F.when(record_id.isNotNull(), record_id)), F.lit(0)) + F.when(record_id.isNull(), F.xxhash64(digest)).otherwise(F.lit(0)), F.lit(n))


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, bundle_bytes: int = BUNDLE_BYTES
) -> None:
    """Write the archive. Payloads of under `least` bytes are never revisits."""
    spark = pages.sparkSession
    n = -(-octets(pages, payload_col) // bundle_bytes) or 1
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha1("payload")).alias("sha"))
    slim = written(rows.where(F.octet_length("payload") >= least).select("id", "sha"), "payload-digests")
    same = written(slim.groupBy("sha").agg(F.max("id").alias("target"), F.count("*").alias("copies")).where("copies > 1"), "shared-payloads")
    # The few payloads with very many copies travel to their records, if they are few, so that no task gets all of those.
    hot = same.where(F.col("copies") > HOT_COPIES)
    side = F.broadcast(hot) if 64 * hot.count() <= LIST_BYTES else hot
    again = slim.join(side, "sha").unionByName(slim.join(same.where(F.col("copies") <= HOT_COPIES), "sha")).where("target is null or id is null or id <= target")
    again = again.select(F.col("id").alias("of"), F.col("sha").alias("by"), "target", home(F.col("id"), F.col("sha"), n).alias("home")).distinct()

    def run(records: pa.Table, revisits: pa.Table) -> pa.Table:
        targets = {(i, s): t for i, s, t in zip(*(revisits.column(c).to_pylist() for c in ("of", "by", "target")))}
        out, first = [], set()
        for i, url, payload, sha in zip(*(records.column(c).to_pylist() for c in ("id", "url", "payload", "sha"))):
            refers = None
            if (i, sha) in targets:
                target = targets[i, sha]
                if target != i or (i, sha) in first:
                    refers = (target,)
                first.add((i, sha))
            out.append((i, record(i, url, payload, refers)))
        return pa.table({"content": pa.array([bundle(out)] if out else [], pa.binary())})

    # A task gets about BUNDLES_A_TASK bundles however large the archive is.
    tasks = n // BUNDLES_A_TASK + 1
    dealt = rows.withColumn("bundle", home(F.col("id"), F.col("sha"), n)).repartition(tasks, "bundle")
    made = dealt.groupBy("bundle").cogroup(again.repartition(tasks, "home").groupBy("home")).applyInArrow(run, "content binary")
    made.select(F.col("content").cast("string")).write.option("lineSep", TAIL.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive, each digest computed again from the payload that its frame holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = Bundle(content.as_py())
                rows = []
                for _, *place in held.index:
                    fields, payload = held.at(*place)
                    digest, kind = fields["WARC-Payload-Digest"].partition(":")[2], fields["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((of_urn(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), digest, kind, of_urn(refers) if refers else None))
                long, text = pa.int64(), pa.string()
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((long, long, text, text, long))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


INDEX = "id bigint, file string, frame bigint, offset bigint, length bigint"


def write_index(spark: SparkSession, path: str) -> None:
    """The archive's own map of record ids to bundle, frame and place in the frame, as a Parquet table in range order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = Bundle(content.as_py()).index
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([file] * len(rows)), *columns[1:]], names=[c.split()[0] for c in INDEX.split(", ")])

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    files.mapInArrow(run, INDEX).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/_index")


def lookup(spark: SparkSession, path: str, ids: list[int | None]) -> list[tuple[dict[str, str], bytes]]:
    """Fields and payloads of the records with these ids: their rows of the index, then the bundles these name, and of each
    bundle the frames that hold them. What comes back grows with the ids asked for only."""
    known = [i for i in ids if i is not None]
    asked = F.col("id").isin(known) | (F.col("id").isNull() if None in ids else F.lit(False))
    places: dict[str, list[tuple[int, int, int]]] = {}
    for _, file, *place in spark.read.schema(INDEX).parquet(f"{path}/_index").where(asked).collect():
        places.setdefault(file, []).append(tuple(place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = Bundle(content.as_py())
                found = [held.at(*place) for place in sorted(places[file])]
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(f) for f, _ in found]), pa.array([p for _, p in found], pa.binary())], names=["fields", "payload"])

    if not places:
        return []
    files = spark.read.format("binaryFile").load(list(places)).select("path", "content")
    return [(json.loads(r[0]), bytes(r[1])) for r in files.mapInArrow(run, "fields string, payload binary").collect()]


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages to `path` (a new folder among the shared ones where it is None) and read the archive back."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read_back(pages.sparkSession, path)
