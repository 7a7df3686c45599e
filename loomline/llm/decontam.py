"""Benchmark decontamination by winnowing.

Of every `window` consecutive k-gram hashes the smallest is kept as a fingerprint, on both sides. A shared span of
window + k - 1 words holds one shared window of hashes, so its smallest hash is a fingerprint on either side: with k = 4 and
window = 7 no shared span of 10 words is missed. An item of fewer than 10 words is one window, its whole n-gram the fingerprint.

1. The benchmark's windows, each with its fingerprint and the ids of the items that hold it, become a table.
2. Documents are read once. Where a fingerprint may be one of the benchmark's, it is extended to the windows that it
   stands for, and these leave as rows with their words. A bitmap of the benchmark's fingerprints says which may be: up to
   FILTER_BITS bits however large the benchmark; with more fingerprints than that suits it lets more rows through, none less.
3. Spark joins both on fingerprint and words, so equality is decided word by word. The benchmark's side is broadcast if it is
   measured at BROADCAST_BYTES or less; a larger one is joined without a hint, shuffled by fingerprint.
4. Hits go back to their documents by row number, and unite to spans.

Cases: null or empty texts have no words and no hits, null or empty items no windows; a very long text costs its windows that
pass the bitmap, others nothing; repeated rows of `docs` give a row each; repeated item ids count once; null item ids mark words but
are not listed; windows that several items hold count for each; an empty benchmark marks nothing; only the ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import ALNUM, ROW, WordHash, as_bytes, bounded_batches, gram_hash, sliding_min, without_rows, written

SPAN = 10
K = 4
FILTER_BITS = 1 << 26
BROADCAST_BYTES = 32 << 20
FOUND = "__loomline_found"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def fingerprints(h: np.ndarray, n: int, span: int = SPAN, k: int = K) -> np.ndarray:
    """For the word hashes of a text, the fingerprint of each window of n words: the smallest k-gram hash in it, for windows shorter
    than the span the hash of all of it."""
    if n < span:
        return gram_hash(h, n) ^ np.uint64(n)
    return sliding_min(gram_hash(h, k), n - k + 1)


def item_windows(items: DataFrame, item_id: str, item_text: str, span: int = SPAN) -> DataFrame:
    """(n, fp, win, items): the distinct windows of all items, the ids that hold them as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                n = min(len(words), span)
                fps = fingerprints(hashed(words), n, span).view(np.int64).tolist() if n else []
                rows += {(item, n, fp, b" ".join(words[s : s + n])) for s, fp in enumerate(fps)}
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["item", "n", "fp", "win"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), item_text).mapInArrow(run, "item string, n int, fp bigint, win binary")
    return written(rows.groupBy("n", "fp", "win").agg(F.collect_set("item").alias("items")), "benchmark-windows")


def slots(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(fp >> np.uint64(shift)) & np.uint64(bits - 1) for shift in (0, 32)]


def bitmap(windows: DataFrame) -> tuple[int, np.ndarray, list[int]]:
    """(bits, the bitmap of all fingerprints, two bits each, and the widths of windows there are). What is collected is bounded by
    FILTER_BITS, not by the benchmark."""
    widths = {r[0]: r[1] for r in windows.groupBy("n").agg(F.count("*")).collect()}
    bits = min(1 << 16, FILTER_BITS)
    while bits < min(FILTER_BITS, 32 * sum(widths.values())):
        bits *= 2
    at = windows.selectExpr(f"explode(array(fp & {bits - 1}L, shiftrightunsigned(fp, 32) & {bits - 1}L)) AS at")
    found = at.groupBy(F.expr("at div 8").alias("octet")).agg(F.expr("bit_or(shiftleft(1, cast(at % 8 AS int)))").alias("flags"))
    held = np.zeros(bits // 8, np.uint8)
    table = found.toArrow()
    held[table.column("octet").to_numpy()] = table.column("flags").to_numpy().astype(np.uint8)
    return bits, held, sorted(widths)


CANDIDATES = T.ArrayType(T.StructType().add("start", "integer").add("n", "integer").add("fp", "long").add("win", "binary"))


def candidates(docs: DataFrame, windows: DataFrame, text_col: str, carried: list[str], span: int = SPAN) -> DataFrame:
    """The carried columns of docs, written, with a number, the count of words and the windows whose fingerprints pass the bitmap."""
    bits, held, widths = bitmap(windows)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("fp", pa.int64()), ("win", pa.binary())]))
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in carried]).schema.fields, T.StructField(ROW, T.LongType()), T.StructField("__loomline_words", T.LongType()), T.StructField(FOUND, CANDIDATES)])

    def may_be(fp: np.ndarray) -> np.ndarray:
        ok = np.ones(len(fp), bool)
        for at in slots(fp, bits):
            ok &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return np.flatnonzero(ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, number = WordHash(), TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, found = [], []
            for text in as_bytes(batch.column(batch.schema.get_field_index(text_col))):
                words = words_of(text)
                h = hashed(words)
                rows = []
                for n in widths:
                    fp = fingerprints(h, n, span)
                    rows += [{"start": s, "n": n, "fp": fp[s].view(np.int64), "win": b" ".join(words[s : s + n])} for s in may_be(fp).tolist()]
                counts.append(len(words))
                found.append(rows)
            numbers = pa.array(np.arange(number, number + len(counts)))
            number += len(counts)
            columns = [*(batch.column(batch.schema.get_field_index(c)) for c in carried), numbers, pa.array(counts, pa.int64()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return written(docs.mapInArrow(run, schema), "candidates")


def hits(found: DataFrame, windows: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(row, start, n, items) of every window that the benchmark holds as well."""
    size = windows.agg(F.coalesce(F.sum(F.octet_length("win") + 24 * F.size("items") + 64), F.lit(0))).first()[0]
    side = F.broadcast(windows) if size <= broadcast_bytes else windows
    asked = found.select(ROW, F.explode(FOUND).alias("c")).select(ROW, "c.start", "c.n", "c.fp", "c.win")
    return asked.join(side, ["fp", "n", "win"]).select(ROW, "start", "n", "items")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per document: words, words hit, items found, whether it is contaminated, the items' ids and the spans of its words that are
    hit. `items` counts distinct item ids."""
    bounded_batches(docs.sparkSession)
    windows = item_windows(items, item_id, item_text)
    found = candidates(docs.select(id_col, text_col), windows, text_col, [id_col])
    span = F.struct(F.col("start").cast("bigint").alias("a"), (F.col("start") + F.col("n")).cast("bigint").alias("b"))
    per_row = hits(found, windows, broadcast_bytes).groupBy(ROW).agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # Windows in order; the fold joins those that overlap or adjoin.
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    last = lambda s: F.element_at(s, -1)
    join = lambda s, x: F.when(
        (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["b"] >= x["a"]),
        F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last(s)["a"].alias("a"), F.greatest(last(s)["b"], x["b"]).alias("b")))),
    ).otherwise(F.concat(s, F.array(x)))
    per_row = per_row.withColumn("spans", F.aggregate("spans", none, join))
    merged = found.select(id_col, ROW, F.col("__loomline_words").alias("n_words")).join(per_row, ROW, "left")
    listed, spans = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("spans", none)
    names = F.concat_ws(",", F.array_sort(listed))
    return merged.select(
        id_col,
        "n_words",
        F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"]).alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
        listed.alias("items"),
        spans.alias("spans"),
    )


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs without any hit, all columns unchanged."""
    bounded_batches(docs.sparkSession)
    windows = item_windows(items, item_id, item_text)
    found = candidates(docs, windows, text_col, docs.columns)
    bad = written(hits(found, windows, broadcast_bytes).select(ROW).distinct(), "contaminated")
    return without_rows(found, bad).select(*[F.col(f"`{c}`") for c in docs.columns])
