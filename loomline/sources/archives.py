"""Tar archives read by many tasks: an index of members made from headers alone, and runs of members by byte offset.

A header says how long its member is, so the next one is found by a jump: an index costs one small read a member, whatever
the members hold. Members belong to the run in which their header begins, so each is in exactly one. Paths are what the driver and
all executors can open, or URIs of a store that pyarrow knows. Archives must not be compressed: there is no jumping in those.
"""

from __future__ import annotations

import fnmatch
import re
import tarfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomline.sources.files import safe_member

#: Bytes of an archive that one task reads.
RUN_BYTES = 64 << 20
#: Content and members that travel at once; a larger member is its batch's last.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000
#: Partitions of the source while they hold less than RUN_BYTES each, and archives whose sizes are asked for at once.
PARTITIONS, ASKED = 256, 16
INDEX = "archive string, name string, start bigint, at bigint, size bigint"


@contextmanager
def opened(path: str):
    """A file that can be sought in."""
    path = re.sub(r"^file:(//)?(?=/)", "", path)
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(name) as f:
        yield f


def jumped(path: str, start: int = 0) -> Iterator[tarfile.TarInfo]:
    """Every member whose header begins from `start`, a header, on. An archive that is broken or cut off is a tarfile.ReadError."""
    with opened(path) as f:
        f.seek(start)
        with tarfile.open(fileobj=f, mode="r:") as tar:
            while (member := tar.next()) is not None:
                tar.members.clear()
                yield member
            f.seek(tar.offset)
            if any(f.read(tarfile.BLOCKSIZE)):
                raise tarfile.ReadError(f"{path} has a broken header at byte {tar.offset}")


def members(path: str, patterns: list[str], start: int = 0, stop: int | None = None) -> Iterator[tarfile.TarInfo]:
    """Matching regular files whose header begins from `start` to before `stop`; one that would leave its folder is a ValueError."""
    for member in jumped(path, start):
        if stop is not None and member.offset >= stop:
            return
        if member.isfile() and any(fnmatch.fnmatch(member.name, p) for p in patterns):
            safe_member(member.name, Path("/nowhere"))
            yield member


def size_of(path: str) -> int:
    with opened(path) as f:
        return f.size()


def runs(path: str, run_bytes: int) -> list[tuple[int, int]]:
    """(start, stop) of stretches of about run_bytes that begin at a header; the jumps are made here, only the stretches are kept."""
    out, begun = [], None
    for member in jumped(path):
        start = member.offset
        if begun is None or start - begun >= run_bytes:
            if begun is not None:
                out.append((begun, start))
            begun = start
    if begun is not None:
        with opened(path) as f:
            out.append((begun, f.size()))
    return out


def tar_index(spark: SparkSession, archives: list[str], patterns: list[str] | None = None) -> DataFrame:
    """(archive, name, start, at, size): where each matching member's header and content begin. A task an archive reads headers only;
    write it as a table to keep it."""
    wanted = patterns or ["*"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [(path, m.name, m.offset, m.offset_data, m.size) for m in members(path, wanted)]
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 10_000])], names=["archive", "name", "start", "at", "size"])

    paths = spark.createDataFrame([(p,) for p in archives], "archive string").repartition(max(1, len(archives)), "archive")
    return paths.mapInArrow(run, INDEX)


def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Members (archive, name, size, content) in batches of about BATCH_BYTES."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    held, full = [], 0
    for row in rows:
        held.append(row)
        full += len(row[3])
        if full >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["archive", "name", "size", "content"])
            held, full = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=["archive", "name", "size", "content"])


def tar_contents(index: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(archive, name, size, content) of an index's members, or of those that are left of it after a filter. Members go to tasks by
    stretches of their archive; each task opens an archive once and reads what it needs in order."""
    slim = index.select("archive", "name", "start", "at", "size", F.expr(f"start div {run_bytes}").alias("run_"))
    dealt = slim.repartition("archive", "run_").sortWithinPartitions("archive", "start").drop("run_")

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        by = {}
        for archive, name, _, at, size in zip(*(c.to_pylist() for c in batch.columns)):
            by.setdefault(archive, []).append((name, at, size))
        for archive, wanted in by.items():
            with opened(archive) as f:
                for name, at, size in wanted:
                    f.seek(at)
                    content = f.read(size)
                    if len(content) != size:
                        raise tarfile.ReadError(f"{archive} ends inside {name!r}")
                    yield archive, name, size, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batched(rows(batch))

    return dealt.mapInArrow(run, "archive string, name string, size bigint, content binary")


class TarSource(DataSource):
    """spark.read.format("loomline_tar").option("patterns", "*.wav").load("a.tar,b.tar"): members as rows. A partition holds stretches of
    archives, of option `run_bytes` together or, where these would be over PARTITIONS, of an equal share of all bytes up to RUN_BYTES: a task
    costs the driver the same whatever it reads."""

    @classmethod
    def name(cls) -> str:
        return "loomline_tar"

    def schema(self) -> str:
        return "archive string, name string, size bigint, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.patterns = options.get("patterns", "*").split(",")
        self.run_bytes = int(options.get("run_bytes", RUN_BYTES))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"paths": []}  # tasks have those of their partition

    def partitions(self) -> list[InputPartition]:
        """Only archives that are cut have their headers read here."""
        with ThreadPoolExecutor(ASKED) as pool:
            sizes = list(pool.map(size_of, self.paths))
        most = max(self.run_bytes, min(RUN_BYTES, sum(sizes) // PARTITIONS))
        out, held, full = [], [], 0
        for path, size in zip(self.paths, sizes):
            for start, stop in runs(path, most) if size > most else [(0, size)]:
                held.append((path, start, stop))
                full += stop - start
                if full >= most:
                    out.append(InputPartition(held))
                    held, full = [], 0
        return out + [InputPartition(held)] if held else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """In batches of bounded bytes: rows would travel by ten thousands, whatever they hold."""
        return batched(self.rows(partition))

    def rows(self, partition: InputPartition) -> Iterator[tuple]:
        for path, start, stop in partition.value:
            with opened(path) as f:
                for member in members(path, self.patterns, start, stop):
                    f.seek(member.offset_data)
                    content = f.read(member.size)
                    if len(content) != member.size:
                        raise tarfile.ReadError(f"{path} ends inside {member.name!r}")
                    yield path, member.name, member.size, content


def lacking_files(index: DataFrame, present: DataFrame) -> DataFrame:
    """Members that are not there yet with their size. present: (name, size) of a listing."""
    return index.join(present.select("name", "size").distinct(), ["name", "size"], "left_anti")
