"""Exact top-k by inner product with pivot-table elimination.

A bounded sample gives the pivots: each the sampled vector farthest from those before it. Every row's distances to all pivots are
computed once. For a query q and a row c, |d(q, p) - d(c, p)| never exceeds their distance, so the largest of them over the
pivots bounds the score from above: (|q|^2 + |c|^2 - bound^2) / 2. Rows are range-sorted by nearest pivot and distance to it and
cut into chunks, one table row each, with the chunk's least and largest distance to each pivot; queries are cut into packs the
same way. A pack meets a chunk only as a cell: first the chunk with the best bound of each query, whose k-th score is the
query's threshold; then every chunk whose bound reaches the threshold of a query of the pack. In a cell a query's candidates are
evaluated in the order of their bounds, until the next bound is below the k-th score. Scores are whole numbers, bounds are
rounded outwards, and rows with bounds equal to the k-th score are evaluated, so the result is exact, ties included.

Of equal vectors only the k + 1 rows with the smallest ids can be among a query's k best other rows, so no others become
candidates, however many copies there are (all of them may be queries). Chunks and packs have a bounded number of rows, so
no key gathers rows; work for a query outside its chunks is a bound for each chunk.

Cases: vectors that are null, hold null or non-finite entries, or have another length than most (the longer one of equals) take no
part; a row's own copy is any row but itself, repeated ids included; a null id is no query and comes last among ties; with
fewer than k other rows a query gets those there are; an empty table gives an empty result; other columns are not read. Numbers
so large that a score wouldn't fit a long are an ArithmeticError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, written
from loomline.llm.vectors import common_length, matrix, usable, whole_numbers

#: Sampled rows, of the smallest hashes, that pivots are chosen from.
SAMPLE = 2048
#: Chunks whose summaries travel as one row.
TOGETHER = 1024
#: Relative error that a distance of 32 bits may have; bounds allow for it.
SLACK = 1e-6
#: Stands for a null id, which is last.
LAST = (1 << 63) - 1
#: Candidates evaluated between two looks at the k-th score.
STEP = 512


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot, rounded to 32 bits."""
    x = x.astype(np.float64)
    return np.sqrt(np.maximum(squares(x)[:, None] + squares(pivots)[None, :] - 2 * (x @ pivots.T), 0)).astype(np.float32)


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` distinct rows, each the farthest from those before it, from the first on."""
    x = x.astype(np.float64)
    chosen, near = [0], squares(x - x[0])
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squares(x - x[chosen[-1]]))
    return x[chosen]


PACKED = "block bigint, rows binary, ids binary, x binary, table binary, norms binary, low binary, high binary, top double"


def blocks(rows: DataFrame, pivots: np.ndarray, kind: str, most: int, name: str) -> DataFrame:
    """Rows (row_, id_, x_) near the same pivot, and at like distance from it, as one row of up to `most`: numbers, ids, vectors,
    pivot table, squared norms, and the least and largest distances and the largest norm of the block."""
    width = pivots.shape[1]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = distances(matrix(batch.column(2), width), pivots)
            home = table.argmin(axis=1)
            more = [pa.array(home.astype(np.int32)), pa.array(table[np.arange(len(home)), home])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["row_", "id_", "x_", "home_", "near_"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for a in range(0, len(batch), most):
                part = batch.slice(a, most)
                while len(part):
                    now = part.slice(0, most - n)
                    held.append(now)
                    n, part = n + len(now), part.slice(len(now))
                    if n == most:
                        yield packed(block, held)
                        block, held, n = block + 1, [], 0
        if held:
            yield packed(block, held)

    def packed(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        x = matrix(whole["x_"].combine_chunks(), width)
        table = distances(x, pivots)
        norms = squares(x.astype(np.float64))
        blobs = {
            "rows": whole["row_"].to_numpy(),
            "ids": whole["id_"].fill_null(LAST).to_numpy(),
            "x": x.astype(kind),
            "table": np.ascontiguousarray(table.T),
            "norms": norms,
            "low": table.min(axis=0),
            "high": table.max(axis=0),
        }
        return pa.RecordBatch.from_pydict({"block": [block], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()}, "top": [float(norms.max())]})

    placed = written(rows.mapInArrow(homes, "row_ bigint, id_ bigint, x_ array<bigint>, home_ int, near_ float"), f"{name}-homes")
    order = ["home_", "near_", "row_"]
    return written(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("home_", "near_").mapInArrow(cut, PACKED), name)


def upper_bound(norms, top, apart: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """No score is above it: `apart` is a lower bound of the distance up to the rounding of its 32-bit terms of size `scale`."""
    sure = np.maximum(apart - 4 * SLACK * scale, 0)
    bound = (norms + top - np.square(sure)) / 2
    return bound + SLACK * (norms + top) + 1


def chunk_bounds(pack: dict, chunks: dict, pivots: int) -> np.ndarray:
    """For every query of a pack (rows) and chunk (columns)."""
    table = np.frombuffer(pack["table"], np.float32).reshape(pivots, -1)
    norms = np.frombuffer(pack["norms"])
    low, high = (np.frombuffer(b"".join(c[k] for c in chunks), np.float32).reshape(len(chunks), pivots) for k in ("low", "high"))
    apart = np.zeros((len(norms), len(chunks)))
    for p in range(pivots):
        d = table[p][:, None].astype(np.float64)
        np.maximum(apart, low[:, p][None, :] - d, out=apart)
        np.maximum(apart, d - high[:, p][None, :], out=apart)
    scale = table.max(axis=0)[:, None].astype(np.float64) + high.max(axis=1)[None, :]
    return upper_bound(norms[:, None], np.array([c["top"] for c in chunks])[None, :], apart, scale)


def routed(packs: DataFrame, chunks: DataFrame, schema: str, choose) -> DataFrame:
    """Every pack beside the summaries of all chunks, TOGETHER at a time: a pack's slot meets all of them there. `choose` makes a
    batch of a pack, its bounds, and the chunks' names."""
    groups = max(1, -(-chunks.count() // TOGETHER))
    slots = 64
    summaries = chunks.groupBy(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group_")).agg(F.collect_list(F.struct("block", "low", "high", "top")).alias("chunks"))
    everywhere = summaries.select("chunks", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot_"))
    mine = packs.select("block", "table", "norms", *[c for c in packs.columns if c == "least"], F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pivots = len(r["chunks"][0]["low"]) // 4
                yield choose(r, chunk_bounds(r, r["chunks"], pivots), np.array([c["block"] for c in r["chunks"]]))

    return mine.join(everywhere, "slot_").drop("slot_").mapInArrow(run, schema)


FOUND = "pack bigint, nth int, query_id bigint, row bigint, vec_id bigint, score bigint"


def evaluated(cells: DataFrame, packs: DataFrame, chunks: DataFrame, kind: str, width: int, k: int, exact: bool) -> DataFrame:
    """The k best rows of every cell (pack, chunk) for each query, if they reach its threshold. exact: scores are whole in doubles."""
    left = packs.select(F.col("block").alias("pack"), *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "x", "table", "norms")], *[c for c in packs.columns if c == "least"])
    right = chunks.select(F.col("block").alias("chunk"), "rows", "ids", "x", "table", "norms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from cell(r)

    def cell(r: dict) -> Iterator[pa.RecordBatch]:
        as_longs = lambda key: np.frombuffer(r[key], np.int64)
        rows, ids, norms = as_longs("rows"), as_longs("ids"), np.frombuffer(r["norms"])
        mine, names, squared = as_longs("q_rows"), as_longs("q_ids"), np.frombuffer(r["q_norms"])
        number = np.float64 if exact else np.int64
        x = np.frombuffer(r["x"], kind).reshape(-1, width).astype(number)
        q = np.frombuffer(r["q_x"], kind).reshape(-1, width).astype(number)
        table = np.frombuffer(r["table"], np.float32).reshape(-1, len(rows))
        asked = np.frombuffer(r["q_table"], np.float32).reshape(-1, len(mine))
        reach, out = table.max(axis=0).astype(np.float64), []
        for i in range(len(mine)):
            apart = np.zeros(len(rows), np.float32)
            for p in range(len(table)):
                np.maximum(apart, np.abs(table[p] - asked[p, i]), out=apart)
            bound = upper_bound(squared[i], norms, apart, reach + float(asked[:, i].max()))
            least = r["least"][i] if r.get("least") else None
            order = np.flatnonzero((rows != mine[i]) if least is None else (rows != mine[i]) & (bound >= least))
            order = order[np.argsort(-bound[order], kind="stable")]
            best = np.empty(0, np.int64), np.empty(0, np.int64)  # scores, places
            for a in range(0, len(order), STEP):
                if len(best[0]) == k and bound[order[a]] < best[0][-1]:
                    break
                some = order[a : a + STEP]
                scores = np.concatenate([best[0], (x[some] @ q[i]).astype(np.int64)])
                places = np.concatenate([best[1], some])
                first = np.lexsort((rows[places], ids[places], -scores))[:k]
                best = scores[first], places[first]
            keep = best[0] >= (least if least is not None else -LAST)
            out.append((np.full(keep.sum(), i), best[0][keep], best[1][keep]))
        nth, scores, places = (np.concatenate(c) for c in zip(*out))
        arrays = [np.full(len(nth), r["pack"]), nth.astype(np.int32), names[nth], rows[places], ids[places], scores]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["pack", "nth", "query_id", "row", "vec_id", "score"])

    return cells.join(left, "pack").join(right, "chunk").drop("chunk").mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows with their rank."""
    order = Window.partitionBy("pack", "nth").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    every: int = 100,
    scale: int = 1024,
    pivots: int = 32,
    chunk_rows: int = 16_384,
    pack_rows: int = 4096,
) -> DataFrame:
    """The k other rows of highest inner product for every row whose id is divisible by `every`, ties to the smaller id."""
    spark = rows.sparkSession
    bounded_batches(spark)
    valid = rows.where(usable(F.col(vector_col))).select(F.monotonically_increasing_id().alias("row_"), F.col(id_col).cast("bigint").alias("id_"), whole_numbers(F.col(vector_col), scale).alias("x_"))
    valid = written(valid, "whole-vectors")
    width = common_length(valid, "x_")
    if not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    valid = valid.where(F.size("x_") == width)
    largest = valid.agg(F.max(F.greatest(F.array_max("x_"), -F.array_min("x_")))).first()[0]
    if width * largest * largest > LAST:
        raise ArithmeticError(f"entries of {largest} in {width} dimensions: their products don't fit a long")
    exact, kind = width * largest * largest < 1 << 53, next(t for t in ("int16", "int32", "int64") if largest <= np.iinfo(t).max)

    copies = Window.partitionBy(F.xxhash64("x_"), "x_").orderBy(F.col("id_").asc_nulls_last(), "row_")
    able = written(valid.withColumn("copy_", F.row_number().over(copies)).where(F.col("copy_") <= k + 1).drop("copy_"), "candidates")
    sample = able.orderBy(F.xxhash64("x_", "row_"), "row_").limit(SAMPLE).select("x_").collect()
    chosen = farthest_first(np.array([r["x_"] for r in sample], np.int64), pivots)
    chunks = blocks(able, chosen, kind, chunk_rows, "chunks")
    packs = blocks(valid.where(F.col("id_") % every == 0), chosen, kind, pack_rows, "packs")

    def nearest(r: dict, bounds: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        top = bounds.argmax(axis=1)
        n = len(top)
        return pa.RecordBatch.from_pydict({"pack": np.full(n, r["block"]), "nth": np.arange(n, dtype=np.int32), "chunk": names[top], "bound": bounds[np.arange(n), top]})

    def reached(r: dict, bounds: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        least = np.array([-np.inf if v is None else v for v in r["least"]])
        hit = names[(bounds >= least[:, None]).any(axis=0)]
        return pa.RecordBatch.from_pydict({"pack": np.full(len(hit), r["block"]), "chunk": hit})

    seeds = routed(packs, chunks, "pack bigint, nth int, chunk bigint, bound double", nearest)
    seeds = written(seeds.groupBy("pack", "nth").agg(F.max_by("chunk", F.struct("bound", "chunk")).alias("chunk")).select("pack", "chunk").distinct(), "seed-cells")
    first = written(best(evaluated(seeds, packs, chunks, kind, width, k, exact), k).drop("rank"), "seed-scores")
    held = first.groupBy("pack", "nth").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    # A pack's thresholds, in the order of its queries; null where the first cells had fewer than k rows.
    least = held.groupBy(F.col("pack").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("nth", "score"))).alias("of_"))
    asked = packs.join(least, "block", "left").withColumn("of_", F.coalesce("of_", F.expr("cast(map() as map<int,bigint>)")))
    asked = asked.withColumn("least", F.expr("transform(sequence(0, cast(length(rows) / 8 as int) - 1), i -> element_at(of_, i))")).drop("of_")
    asked = written(asked, "asked")
    rest = written(routed(asked, chunks, "pack bigint, chunk bigint", reached).join(seeds, ["pack", "chunk"], "left_anti"), "cells")
    both = first.unionByName(evaluated(rest, asked, chunks, kind, width, k, exact))
    other = F.when(F.col("vec_id") != LAST, F.col("vec_id"))
    return best(both, k).select("query_id", "rank", other.alias("vec_id"), "score")
