"""Small results as files: atomic JSON, ordered JSON lines, append logs, markdown, provenance, audio."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterable
from datetime import UTC, datetime
from hashlib import md5, sha256
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.components import cut_lineage


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_json(path: str | Path, value: Any) -> None:
    """A JSON document in one step: readers see the old file or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")
    os.replace(name, path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a total order, nulls written; parts are in order too, so the table may be of any size."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not in the log yet, one a key; returns how many. One writer at a time; for batches that may be
    replayed, and logs whose files may go, see `resume`."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    try:
        have = spark.read.schema(df.schema).json(path)
        fresh = fresh.join(have.select(key), key, "left_anti").select(*df.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # no log yet
            raise
    fresh = cut_lineage(fresh, "fresh")  # computed once, counted and written from there
    n = fresh.count()
    if n:
        fresh.write.mode("append").option("ignoreNullFields", "false").json(path)
    return n


def markdown_table(columns: list[str], rows: Iterable[Iterable[Any]], formats: dict[str, str] | None = None) -> str:
    """A markdown table of a small result; formats: Python format of a column's values."""
    formats = formats or {}

    def cell(name: str, value: Any) -> str:
        return "-" if value is None else format(value, formats.get(name, "")).replace("|", "\\|")

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(c, v) for c, v in zip(columns, row)) + " |" for row in rows]
    return "\n".join(lines) + "\n"


def report(title: str, sections: list[tuple[str, DataFrame]], formats: dict[str, str] | None = None, most: int = 1000) -> str:
    """Aggregated tables under headings; each is a summary of at most `most` rows, else it is an error."""
    out = [f"# {title}\n"]
    for heading, df in sections:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{heading!r} has more than {most} rows: not a summary")
        out += [f"\n## {heading}\n", markdown_table(df.columns, rows, formats)]
    return "\n".join(out)


def file_hashes(path: str | Path, chunk: int = 1 << 22) -> dict[str, str]:
    """sha256 and md5 of a file of any size in one pass."""
    a, b = sha256(), md5(usedforsecurity=False)
    with open(path, "rb") as f:
        while block := f.read(chunk):
            a.update(block)
            b.update(block)
    return {"sha256": a.hexdigest(), "md5": b.hexdigest()}


def provenance(path: str | Path, source: str, files: list[str | Path]) -> dict[str, Any]:
    """What was retrieved from where and when, with checksums; also written as JSON."""
    record = {"source": source, "retrieved_at": utc_now(), "files": {str(f): {"bytes": Path(f).stat().st_size} | file_hashes(f) for f in files}}
    write_json(path, record)
    return record


def provenance_rows(files: DataFrame, folder: str, source: str) -> DataFrame:
    """The same for any number of files (binaryFile rows), a row each: source, file below the folder, bytes, checksums, time of retrieval."""
    below = F.substring_index("path", folder.rstrip("/") + "/", -1)
    sums = (F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    return files.select(F.lit(source).alias("source"), below.alias("file"), F.col("length").alias("bytes"), *sums, F.lit(utc_now()).alias("retrieved_at"))


def blinded_page(folder: str | Path, name: str, title: str, trials: list[dict[str, Any]], key: dict[str, Any], key_folder: str | Path, secrets: Iterable[str]) -> Path:
    """An HTML page of blinded trials (label, text) and, in a folder outside the page's, the key that tells labels apart. Raises if
    the key would lie inside the page's folder, or the page or its name would give one of the secret words away."""
    page, keys = Path(folder) / f"{name}.html", Path(key_folder) / f"{name}.key.json"
    if keys.resolve().is_relative_to(Path(folder).resolve()):
        raise ValueError("the key must lie outside the page's folder")
    rows = "".join(f"<li id={quoteattr(str(t['label']))}>{escape(str(t['text']))}</li>" for t in trials)
    html = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><ol>{rows}</ol></body></html>\n"
    if leaks := leaking_words(name + title, secrets):
        raise ValueError(f"the page would give away {leaks}")
    page.parent.mkdir(parents=True, exist_ok=True)
    page.write_text(html, encoding="utf-8")
    write_json(keys, key)
    return page


def remove_tree(path: str | Path, tries: int = 3) -> bool:
    """Delete a folder; what vanishes or comes up meanwhile is no error. Returns whether it is gone."""
    for _ in range(tries):
        shutil.rmtree(path, ignore_errors=True)
        if not Path(path).exists():
            return True
    return False


def leaking_words(page: str, words: Iterable[str]) -> list[str]:
    """Run or style words that a page's name would give away."""
    low = page.lower()
    return sorted({w for w in words if w and w.lower() in low})
