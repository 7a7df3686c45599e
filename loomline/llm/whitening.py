"""Whitening of vectors by a tall-skinny QR: the covariance is never formed.

Entries become whole numbers, so the sums of the distinct vectors (the fit list) are exact and rows are centred by them without
cancellation: x - S/n is taken as (x - S div n) - (S mod n)/n. Each task folds its rows, a few thousand at a time, into one
triangular factor R; factors are merged sixteen at a time up a tree, and the last one's singular value decomposition gives the
eigenvectors of the covariance and, squared and divided by n, its eigenvalues. They are a matrix of the vectors' own size and
go to every task; what travels besides is the distinct vectors once and one small row a task. The covariance of the whitened
fit list is checked the same way, from counts, means and centred products of each task merged up a tree.

Cases: vectors that are null, hold null or non-finite entries, or have another length than most (the longer one of equals) take
no part; empty vectors are of length 0, and if that is most there is no result; repeated rows count once in the fit and are
rows of their own in the result; null ids are kept; a component on which nothing varies (all components if there is one
distinct vector) has null `whitened`, and takes no part in `identity_error`; `explained` is null where the variance is nothing;
a deviation that a long cannot hold is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import written
from loomline.llm.vectors import common_length, matrix, tree_merged, usable, whole_numbers

#: Rows that are folded into R at once.
FOLD = 4096
LONG = (1 << 63) - 1


@dataclass
class Centre:
    """Exact column sums of n rows as quotient and remainder."""

    n: int
    quotient: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over the columns of (n * x - S)^2."""
        off = x - self.quotient
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) <= LONG:
            return (np.square(off * self.n - self.rest).sum(axis=1)).tolist()
        exact = np.square(off.astype(object) * self.n - self.rest.astype(object)).sum(axis=1)
        return [v if v <= LONG else None for v in exact.tolist()]


def column_sums(fit: DataFrame, width: int) -> Centre:
    """Partial sums of every task, added up by Spark column by column: `width` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column(0), width)
            small = len(x) * (int(np.abs(x).max(initial=0)) + 1) <= LONG
            more = (x if small else x.astype(object)).sum(axis=0).tolist()
            rows, sums = rows + len(x), [a + b for a, b in zip(sums, more)]
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64()), "sums": pa.array([sums], pa.list_(pa.decimal128(38, 0)))})

    parts = fit.mapInArrow(run, "rows bigint, sums array<decimal(38,0)>")
    totals = parts.select("rows", F.posexplode("sums")).groupBy("pos").agg(F.sum("rows").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    n = totals[0]["n"]
    of = {r["pos"]: int(r["s"]) for r in totals}
    both = [divmod(of[i], n) for i in range(width)]
    return Centre(n, np.array([q for q, _ in both], np.int64), np.array([r for _, r in both], np.int64))


def folded(factor: bytes | None, rows: np.ndarray) -> bytes:
    """R of the rows below another R."""
    above = np.frombuffer(factor).reshape(-1, rows.shape[1]) if factor else rows[:0]
    return np.linalg.qr(np.vstack([above, rows]), mode="r").tobytes()


def factor(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the whole centred fit list."""
    width = len(centre.quotient)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = matrix(batch.column(0), width)
            for a in range(0, len(x), FOLD):
                r = folded(r, centre.centred(x[a : a + FOLD]))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part_": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r], pa.binary())})

    def merge(found: list[dict]) -> dict:
        return {"r": folded(None, np.vstack([np.frombuffer(f["r"]).reshape(-1, width) for f in found]))}

    return np.frombuffer(tree_merged(fit.mapInArrow(run, "part_ bigint, r binary"), merge, "factors")["r"]).reshape(-1, width)


def joined_moments(a: tuple, b: tuple) -> tuple:
    """(count, means, sums of centred products) of two lots of rows together."""
    (n, mean, m2), (k, other, o2) = a, b
    step = other - mean
    return n + k, mean + step * (k / (n + k)), m2 + o2 + np.outer(step, step) * (n * k / (n + k))


def whitened_covariance(fit: DataFrame, centre: Centre, whitener: np.ndarray) -> np.ndarray:
    """Covariance, divisor n, of the fit list's whitened rows, centred before multiplying."""
    width, k = whitener.shape

    def packed(moments: tuple, part: int) -> dict:
        return {"part_": part, "n": moments[0], "mean": moments[1].tobytes(), "m2": moments[2].tobytes()}

    def unpacked(r: dict) -> tuple:
        return r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"]).reshape(k, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            w = centre.centred(matrix(batch.column(0), width)) @ whitener
            if len(w):
                mean = w.mean(axis=0)
                new = (len(w), mean, (w - mean).T @ (w - mean))
                held = joined_moments(held, new) if held else new
        if held:
            yield pa.RecordBatch.from_pylist([packed(held, TaskContext.get().partitionId())])

    def merge(found: list[dict]) -> dict:
        held = unpacked(found[0])
        for f in found[1:]:
            held = joined_moments(held, unpacked(f))
        return packed(held, 0)

    n, _, m2 = unpacked(tree_merged(fit.mapInArrow(run, "part_ bigint, n bigint, mean binary, m2 binary"), merge, "moments"))
    return m2 / n


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """For every usable row and component (from 1, by falling eigenvalue): the size of the fit list, the row's exact deviation, its
    whitened coordinate, the component's share of the variance, and how far the whitened covariance is from the identity."""
    valid = rows.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id_"), whole_numbers(F.col(vector_col), scale, shift).alias("x_"))
    fit = written(valid.select("x_").distinct(), "distinct-vectors")
    width = common_length(fit, "x_")
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id_ {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not width:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id_", id_col)
    fit = fit.where(F.size("x_") == width)
    centre = column_sums(fit, width)
    _, singular, right = np.linalg.svd(factor(fit, centre))
    singular = np.concatenate([singular, np.zeros(width - len(singular))])
    varying = singular > singular[0] * width * np.finfo(float).eps
    k = min(components, width)
    kept = np.flatnonzero(varying[:k])
    eigen = np.square(singular) / centre.n
    whitener = right[kept].T / np.sqrt(eigen[kept])
    error = float(np.abs(whitened_covariance(fit, centre, whitener) - np.eye(len(kept))).max()) if len(kept) else 0.0
    explained = [float(v) for v in eigen[:k] / eigen.sum()] if varying.any() else [None] * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            x = matrix(batch.column(1), width)
            out = np.full((n, k), np.nan)
            out[:, kept] = centre.centred(x) @ whitener
            each = np.repeat(np.arange(n), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, centre.n)),
                pa.array(centre.deviation(x), pa.int64()).take(pa.array(each)),
                pa.array(out.ravel(), mask=np.tile(~varying[:k], n)),
                pa.array(explained * n, pa.float64()),
                pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id_", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return valid.where(F.size("x_") == width).mapInArrow(run, schema).withColumnRenamed("id_", id_col)
