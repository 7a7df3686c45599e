"""Logs that grow, as a stream: each complete line once.

A file's offset is the byte after its last complete line, with what tells the file from another of its name: its inode and
a checksum of its first line. A half-written last line waits for its end. A file that has shrunk, or begins otherwise, or is another
file by now, is read from its start.

    spark.dataSource.register(TailSource)
    spark.readStream.format("loomline_tail").load("/logs/*.jsonl")
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, and bytes looked at from the end at once for a line's end.
PART_BYTES, LOOK_BYTES = 64 << 20, 1 << 16
#: Bytes of the first line that its checksum covers at most.
HEAD_BYTES = 4096


def complete_bytes(f, size: int) -> int:
    """The byte after the last line's end."""
    at = size
    while at > 0:
        start = max(0, at - LOOK_BYTES)
        f.seek(start)
        found = f.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def offset_of(path: str) -> list[int] | None:
    """[bytes of complete lines, inode, checksum of the first line]; None if there is no complete line or no file."""
    try:
        with open(path, "rb") as f:
            state = os.fstat(f.fileno())
            to = complete_bytes(f, state.st_size)
            f.seek(0)
            return [to, state.st_ino, zlib.crc32(f.readline(min(to, HEAD_BYTES)))] if to else None
    except FileNotFoundError:
        return None


def new_bytes(before: list[int] | None, now: list[int]) -> tuple[int, int]:
    """From where to where a file is new: from its start if it isn't the file that it was."""
    same = before is not None and before[1:] == now[1:] and before[0] <= now[0]
    return (before[0] if same else 0), now[0]


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern, self.part_bytes = options["path"], int(options.get("part_bytes", PART_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: offset for path in sorted(glob.glob(self.pattern, recursive=True)) if (offset := offset_of(path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, now in end.items():
            a, b = new_bytes(start.get(path), now)
            out += [InputPartition((path, x, min(x + self.part_bytes, b), b)) for x in range(a, b, self.part_bytes)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The lines that begin in a stretch of bytes; all but a file's first stretch pass over the line that began before."""
        path, start, stop, end = partition.value
        with open(path, "rb") as f:
            if start:
                f.seek(start - 1)
                f.readline()
            while (at := f.tell()) < stop:
                line = f.readline()
                if not line.endswith(b"\n") or at + len(line) > end:
                    return  # the file was cut after the batch was planned
                yield path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomline_tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TailReader(self.options)
