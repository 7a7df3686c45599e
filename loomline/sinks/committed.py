"""A sink of one file a row that leaves whole results or nothing.

Tasks write into a folder of the job, beside the target, with a list of the files' names; a task tells the driver where its list is, and
only when all tasks are done does the driver move the files to their names, which it reads list by list and doesn't hold. A task that fails or is killed, and the slower of two copies of a task, leave files
only in the job's folder, which goes at the end either way. The target is a folder that the driver and all executors share.

    spark.dataSource.register(FileSink)
    df.select("name", "content").write.format("loomline_files").mode("append").save(folder)
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import batched
from pathlib import Path, PurePosixPath
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loomline.sinks.files import remove_tree

#: Moves at once, names that are held for them, and digests of names that are compared in memory, by so many files of them at most.
MOVERS, HELD, COMPARED, DIGEST_FILES = 16, 10_000, 1 << 20, 256


@dataclass
class Written(WriterCommitMessage):
    """Where the list of a task's files is, and how many they are."""

    files: str
    count: int


def inside(folder: Path, name: str) -> Path:
    """Where a file goes; a name that leads out of the folder is an error."""
    pure = PurePosixPath(name)
    if not name or pure.is_absolute() or ".." in pure.parts:
        raise ValueError(f"unsafe file name {name!r}")
    return folder / pure


def mounted(folder: str) -> Path:
    """A folder that is reached by its path on every machine; file: URIs are such paths, those of other stores are an error."""
    path = re.sub(r"^file:(//)?(?=/)", "", str(folder))
    if re.match(r"^\w+://", path):
        raise ValueError(f"{folder} is not a folder that the driver and all executors have mounted")
    return Path(path)


def part_of(attempt: Path, i: int) -> Path:
    """Where the i-th file of an attempt waits."""
    return attempt / str(i // 1000) / str(i)


def listed(lists: list[str]) -> Iterator[tuple[Path, str]]:
    """(where it is, its name) of every file."""
    for path in lists:
        with open(path, encoding="ascii") as names:
            for i, line in enumerate(names):
                yield part_of(Path(path).parent, i), json.loads(line)


def digest_of(name: str) -> bytes:
    return hashlib.md5(name.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = mounted(folder), overwrite
        self.job = self.folder.with_name(f".{self.folder.name}-{uuid4().hex}")
        self.job.mkdir(parents=True)  # here only: tasks that outlive the job can't bring it back

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's files, under names of this attempt's own."""
        attempt = self.job / uuid4().hex
        attempt.mkdir()
        count = 0
        with open(attempt / "names", "w", encoding="ascii") as names_file:
            for batch in iterator:
                names, contents = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "content"))
                for name, content in zip(names, contents):
                    inside(self.folder, name or "")
                    part = part_of(attempt, count)
                    if count % 1000 == 0:
                        part.parent.mkdir()
                    part.write_bytes(content or b"")
                    names_file.write(json.dumps(name) + "\n")
                    count += 1
        return Written(str(attempt / "names"), count)

    def commit(self, messages: list[Written | None]) -> None:
        """Every file under its name. Repeated names are an error, as is one that is taken already (unless it may be overwritten), before
        any file has moved."""
        lists = [m.files for m in messages if m]
        try:
            self.refuse_repeated(lists, sum(m.count for m in messages if m))
            if not self.overwrite:
                taken = next((n for _, n in listed(lists) if inside(self.folder, n).exists()), None)
                if taken is not None:
                    raise FileExistsError(f"{taken!r} is there already")
            for some in batched(listed(lists), HELD):
                for parent in {inside(self.folder, n).parent for _, n in some}:
                    parent.mkdir(parents=True, exist_ok=True)
            with ThreadPoolExecutor(MOVERS) as pool:
                for some in batched(listed(lists), HELD):
                    list(pool.map(lambda f: f[0].replace(inside(self.folder, f[1])), some))
        finally:
            remove_tree(self.job)

    def refuse_repeated(self, lists: list[str], count: int) -> None:
        """An error if two files have one name. Digests of the names are dealt out to files, which are compared one after the other."""
        digests = [self.job / f"digests-{i}" for i in range(min(DIGEST_FILES, count // COMPARED + 1))]
        with ExitStack() as stack:
            outs = [stack.enter_context(open(d, "wb")) for d in digests]
            for _, name in listed(lists):
                digest = digest_of(name)
                outs[int.from_bytes(digest[:4], "little") % len(outs)].write(digest)
        for d in digests:
            found, times = np.unique(np.fromfile(d, "S16"), return_counts=True)
            if len(times) and times.max() > 1:
                most = bytes(found[times.argmax()])
                name = next(n for _, n in listed(lists) if digest_of(n).rstrip(b"\0") == most)
                raise ValueError(f"{times.max()} rows are named {name!r}")

    def abort(self, messages: list[Written | None]) -> None:
        remove_tree(self.job, tries=20)  # tasks may still be writing


class FileSink(DataSource):
    """Rows (name string, content binary) as files of a folder. Option `replace`: whether a file that is there may be written anew."""

    @classmethod
    def name(cls) -> str:
        return "loomline_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite or self.options.get("replace", "true").lower() == "true")


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content", replace: bool = True) -> None:
    """One file a row, all or none of them. The driver moves the files; it holds HELD names, or COMPARED digests of names, at once."""
    df.sparkSession.dataSource.register(FileSink)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    rows.write.format("loomline_files").mode("append").option("replace", str(replace)).save(str(folder))
