"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.components import cut_lineage

#: What `bytes.split()` and the class [^\x20\x09-\x0D] call white space.
WHITE = b" \t\n\r\x0b\f"
#: Bytes that end a word of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] become spaces, A-Z become a-z.
ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
#: A-Z to a-z, all else unchanged.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Text handled at once inside a Python worker.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the folder that all executors share, read back: it cuts lineage and outlives executors."""
    return cut_lineage(df, name)


ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "67108864")


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let this session send texts to Python in batches of about `most` instead of its default of 64 MB; another value stays.
    Both sides hold a batch several times over, so this bounds an executor's memory. The setting is read when a plan runs,
    which is after the operator has returned, so it stays for the session's later queries."""
    if spark.conf.get(ARROW_BYTES, ARROW_DEFAULT[0]) in ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, most)


ROW, GROUP = "__loomline_row", "__loomline_group"


def dealt(docs: DataFrame, text_col: str, group_bytes: int, name: str = "numbered") -> DataFrame:
    """The documents with a row number and a group, in a written table: the numbers stay whatever is computed anew. A group is
    a run of neighbouring rows with `group_bytes` of text; a longer text is its group's last."""
    schema = T.StructType([*docs.schema.fields, T.StructField(ROW, T.LongType()), T.StructField(GROUP, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        row, group, held = first, first, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy()
            groups = []
            for n in sizes.tolist():
                if held >= group_bytes:
                    group, held = group + 1, 0
                groups.append(group)
                held += n
            numbers = np.arange(row, row + len(sizes))
            row += len(sizes)
            columns = [*batch.columns, pa.array(numbers), pa.array(groups, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, ROW, GROUP])

    return written(docs.mapInArrow(run, schema), name)


def octets(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column, null as none: one aggregate that sizes partitions and checks broadcasts."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


#: A list of row numbers of up to so many bytes travels to the rows; beyond it the rows are shuffled to meet it.
LIST_BYTES = 32 << 20


def without_rows(df: DataFrame, rows: DataFrame, list_bytes: int = LIST_BYTES) -> DataFrame:
    """The rows of df whose number (ROW) is not among those of `rows`, a written table of distinct numbers."""
    small = 16 * rows.count() <= list_bytes
    return df.join(F.broadcast(rows) if small else rows, ROW, "left_anti")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` bytes; a longer text is alone in its range."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


class WordHash:
    """64-bit word hashes, the same on every executor. One cache a process, emptied when it holds MOST words."""

    MOST = 300_000
    known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = WordHash.known
        if len(known) > self.MOST:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, by doubling: the values' order counts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    have, width = h, 1
    out, done = None, 0
    left = k
    while True:
        if left & 1:
            part = have[done : done + n]
            out = part.copy() if out is None else out * ODD + part
            done += width
        left >>= 1
        if not left:
            return mix(out)
        have = mix(have[:-width] * ODD + have[width:])
        width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, width = x, 1
    while width * 2 <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    return np.minimum(have[:n], have[w - width : w - width + n])
