"""File scans: discovery, transcripts, lists, JSON, logs and archives."""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
import tarfile
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from itertools import batched
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.text import base_name, is_junk, parse_stem
from loomline.operators.components import cut_lineage

CLIP_PARTS = ("speaker", "style", "corpus", "file")


#: Files of a folder that Spark's own listing may hold in the driver.
DRIVER_LISTS = 10_000
#: A task reads so many files or bytes; bytes of content that travel at once, and names.
TASK_FILES, TASK_BYTES, BATCH_BYTES, BATCH_ROWS = 5000, 16 << 20, 4 << 20, 10_000


def shown(name: str) -> bool:
    """Whether Spark's listing goes into a folder, or takes a file, of this name."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def entries(folder: str, deep: bool) -> Iterator[str]:
    """What a folder shows: its files and folders or, `deep`, the files of all folders below."""
    todo = [folder]
    while todo:
        with os.scandir(todo.pop()) as found:
            for entry in found:
                if not shown(entry.name):
                    continue
                if deep and entry.is_dir():
                    todo.append(entry.path)
                else:
                    yield entry.path


def large_folder(root: str, pattern: str) -> str | None:
    """The path of a mounted folder of more files than DRIVER_LISTS; None of any other place, and of patterns that are more than * and ?."""
    path = re.sub(r"^file:(//)?(?=/)", "", root)
    if re.search(r"[][*?{}\\]|^\w+:", path) or re.search(r"[][{}\\]", pattern) or not os.path.isdir(path):
        return None
    path = os.path.abspath(path)
    return path if any(i == DRIVER_LISTS for i, _ in enumerate(entries(path, True))) else None


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, modificationTime, length) of a large folder's files as a table. One task lists the folder itself, many ask for what it holds."""
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for some in batched(entries(path, False), BATCH_ROWS):
                    yield pa.RecordBatch.from_pydict({"path": list(some)})

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for file in entries(path, True) if os.path.isdir(path) else (path,):
                    if fnmatch.fnmatchcase(os.path.basename(file), pattern) and (stat := os.stat(file)).st_size:
                        yield f"file:{file}", stat.st_mtime_ns // 1_000_000 * 1000, stat.st_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(below(batches), BATCH_ROWS):
            path, changed, length = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(changed, pa.timestamp("us", "UTC")), pa.array(length, pa.int64())], names=["path", "modificationTime", "length"])

    held = spark.createDataFrame([(folder,)], "path string").coalesce(1).mapInArrow(top, "path string")
    dealt = held.repartition(2 * spark.sparkContext.defaultParallelism)
    return cut_lineage(dealt.mapInArrow(run, "path string, modificationTime timestamp, length bigint"), "listing")


def dealt_out(found: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """A listing in as many parts as its files, or their bytes, ask for."""
    n = found.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return found.repartition(max(found.sparkSession.sparkContext.defaultParallelism, n.files // TASK_FILES + 1, n.bytes // task_bytes + 1 if task_bytes else 1))


def listed_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path, modificationTime, length) of every matching file below root. The driver holds DRIVER_LISTS of them at most, if root is a mounted folder."""
    folder = large_folder(root, pattern)
    if folder is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).drop("content")
    return dealt_out(listing(spark, folder, pattern))


def binary_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """The same with their content, which is read only if it is used where the folder is no large one (`listed_files` never reads it)."""
    folder = large_folder(root, pattern)
    if folder is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, held, begun, full = batch.column(0).to_pylist(), [], 0, 0
            for i, name in enumerate(names):
                held.append(Path(name.removeprefix("file:")).read_bytes())
                full += len(held[-1])
                if full >= BATCH_BYTES or i + 1 == len(names):
                    yield pa.RecordBatch.from_arrays([*batch.slice(begun, len(held)).columns, pa.array(held, pa.binary())], names=["path", "modificationTime", "length", "content"])
                    held, begun, full = [], i + 1, 0

    found = dealt_out(listing(spark, folder, pattern), TASK_BYTES)
    return found.mapInArrow(read, "path string, modificationTime timestamp, length bigint, content binary")


def discovered(paths: DataFrame, root: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(clips, problems) of file paths that should read root/speaker/style/corpus/file. Junk is dropped; another depth is a
    problem and no clip; a name that disagrees with its folders is a problem and still a clip."""
    below = F.regexp_replace(F.col(path), rf"^.*?{root.rstrip('/')}/", "")
    rows = paths.select(below.alias("file")).where(~is_junk(base_name(below)))
    rows = rows.withColumn("parts", F.split("file", "/"))
    deep = rows.where(F.size("parts") == len(CLIP_PARTS))
    stem = F.regexp_replace(F.col("parts")[3], r"\.[^.]*$", "")
    named = deep.select("file", stem.alias("stem"), F.col("parts")[0].alias("speaker"), F.col("parts")[1].alias("style"), F.col("parts")[2].alias("corpus"), parse_stem(stem).alias("said"))
    clips = named.select("file", "stem", "speaker", "style", "corpus", F.col("said.substyle").alias("substyle"))
    agrees = (F.col("said.speaker") == F.col("speaker")) & (F.col("said.style") == F.col("style"))
    problems = rows.where(F.size("parts") != len(CLIP_PARTS)).select("file", F.lit("unexpected depth").alias("problem"))
    problems = problems.unionByName(named.where(~F.coalesce(agrees, F.lit(False))).select("file", F.lit("name disagrees with folders").alias("problem")))
    return clips, problems


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, content), lines counted from 1. Each file is one value, so a line's number does not depend on splits."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r\n|\n|\r").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("at", "content")).select("file", (F.col("at") + 1).alias("line"), "content")


def transcripts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stem, text) and (line, problem, content) of lines `stem TAB text`: blank lines are skipped, lines without a tab or a
    stem are problems, of repeated stems (trimmed first) the first line counts and the others are problems."""
    filled = lines.where(F.trim("content") != "").withColumn("stem", F.trim(F.substring_index("content", "\t", 1)))
    has_tab = F.instr("content", "\t") > 0
    good = filled.where(has_tab & (F.col("stem") != "")).withColumn("text", F.trim(F.expr("substring(content, instr(content, '\t') + 1)")))
    ranked = good.withColumn("nth", F.row_number().over(Window.partitionBy("stem").orderBy("line")))
    bad = filled.where(~(has_tab & (F.col("stem") != ""))).select("line", F.lit("no tab separator").alias("problem"), F.substring("content", 1, 80).alias("content"))
    again = ranked.where("nth > 1").select("line", F.concat(F.lit("duplicate transcript for "), "stem").alias("problem"), F.lit(None).cast("string").alias("content"))
    return ranked.where("nth = 1").select("stem", "text"), bad.unionByName(again)


def split_list(lines: DataFrame) -> DataFrame:
    """Stems of official lists: comments skipped, the first tab field, none whose first _ part has a dash."""
    rows = lines.where(~F.trim("content").startswith("#") & (F.trim("content") != "")).select(F.trim(F.substring_index("content", "\t", 1)).alias("stem"))
    return rows.where(~F.contains(F.substring_index("stem", "_", 1), F.lit("-"))).distinct()


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a known schema; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def eval_losses(lines: DataFrame) -> DataFrame:
    """(step, loss, line) of `Eval results for step (N / M | Eval Loss: x` lines."""
    form = r"Eval results for step \((\d+) / \d+ \| Eval Loss: ([0-9.]+)"
    found = lines.where(F.col("content").rlike(form))
    return found.select(F.regexp_extract("content", form, 1).cast("bigint").alias("step"), F.regexp_extract("content", form, 2).cast("double").alias("loss"), "line")


def checkpoint_step(name: Column) -> Column:
    """Step of a folder named checkpoint-N or checkpoint-N-epoch-M; null for others."""
    form = r"^checkpoint-(\d+)(?:-epoch-\d+)?$"
    return F.when(name.rlike(form), F.regexp_extract(name, form, 1).cast("bigint"))


def safe_member(name: str, dest: Path) -> Path:
    """Where an archive member goes; raises if that is outside dest."""
    pure = PurePosixPath(name)
    target = (dest / pure).resolve()
    if pure.is_absolute() or not target.is_relative_to(dest.resolve()):
        raise ValueError(f"unsafe archive member {name!r}")
    return target


def extract_tar(archive: str | Path, dest: str | Path, patterns: list[str]) -> dict[str, int]:
    """Extract matching regular files; files of the right size are kept, others come by a temporary name."""
    dest, counts = Path(dest), {"extracted": 0, "present": 0, "skipped": 0}
    with tarfile.open(archive) as tar:
        for member in tar:
            if not (member.isfile() or member.isdir()) or not any(fnmatch.fnmatch(member.name, p) for p in patterns):
                counts["skipped"] += 1
                continue
            target = safe_member(member.name, dest)
            if member.isdir():
                target.mkdir(parents=True, exist_ok=True)
            elif target.is_file() and target.stat().st_size == member.size:
                counts["present"] += 1
            else:
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_name(target.name + ".part")
                with open(part, "wb") as out:
                    shutil.copyfileobj(tar.extractfile(member), out, 1 << 20)
                part.replace(target)
                counts["extracted"] += 1
    return counts


def remote_head(url: str) -> dict[str, str | int | None]:
    """Size, etag, date and range support of a URL."""
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD")) as r:
        h = r.headers
        return {"size": int(h["Content-Length"]) if h["Content-Length"] else None, "etag": h["ETag"], "last_modified": h["Last-Modified"], "accept_ranges": h["Accept-Ranges"]}


def download(url: str, part: str | Path, size: int, etag: str | None = None, failures: int = 20, wait=time.sleep) -> int:
    """Resume a download into `part`. The server must answer a range with 206, or the download fails; a changed etag starts
    over; waits double up to a minute, and progress resets them. Returns the bytes fetched."""
    part, failed, fetched = Path(part), 0, 0
    while (have := part.stat().st_size if part.exists() else 0) < size:
        headers = {"Range": f"bytes={have}-"} | ({"If-Range": etag} if etag else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers if have else {})) as r:
                if have and r.status == 200:
                    if etag and r.headers["ETag"] != etag:
                        part.unlink()
                        etag = r.headers["ETag"]
                        continue
                    raise ValueError("the server ignored the range")
                with open(part, "ab") as out:
                    while chunk := r.read(1 << 20):
                        out.write(chunk)
                        fetched, failed = fetched + len(chunk), 0
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            failed += 1
            if failed > failures:
                raise OSError(f"{failed} failures in a row") from e
            wait(min(60, 2**failed))
    return fetched
