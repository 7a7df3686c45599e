"""Whitening and exact top-k against numpy over the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import pivots, vectors, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n bigint, rank int, x_ string"


def random_rows(count, width, seed, groups=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (groups, width))
    return [(i, [float(np.float32(v)) for v in centres[i % groups] + rng.normal(0, 0.2, width)]) for i in range(count)]


@pytest.fixture(scope="module")
def troubled():
    """Copies, ties, repeated rows and ids, null ids, and vectors that take no part."""
    rows = random_rows(400, 6, 3)
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third is one vector, some of its rows are queries
    rows += [rows[100], rows[100], (100, rows[3][1]), (None, rows[5][1]), (None, rows[200][1])]
    bad = [None, [], [0.1] * 5, [0.1] * 5 + [None], [float("nan")] + [0.1] * 5, [0.1] * 5 + [float("-inf")], [None] * 6]
    rows += [(2000 + 100 * i, v) for i, v in enumerate(bad)]
    return rows


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, 3, "y") for i, v in rows], SCHEMA).repartition(parts)


def usable(rows, width=6):
    return [(i, np.array(v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]


def plain_top(rows, k=10, every=100):
    whole = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in usable(rows)]
    out = []
    for a, (i, x) in enumerate(whole):
        if i is not None and i % every == 0:
            others = [(-int(x @ y), math.inf if j is None else j) for b, (j, y) in enumerate(whole) if a != b]
            out += [(i, r, None if j == math.inf else j, -s) for r, (s, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 32, "pack_rows": 2, "pivots": 5}])
def test_top_k(spark, troubled, sizes):
    found = pivots.top_k(table(spark, troubled), **sizes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_top(troubled)


def test_top_k_of_few_rows(spark):
    rows = random_rows(4, 3, 1)
    found = sorted(map(tuple, pivots.top_k(table(spark, rows)).collect()))
    assert len(found) == 3 and [r[1] for r in found] == [1, 2, 3] and {r[2] for r in found} == {1, 2, 3}
    assert pivots.top_k(table(spark, rows[:1])).count() == 0
    assert pivots.top_k(table(spark, rows[1:])).count() == 0
    assert pivots.top_k(table(spark, rows).limit(0)).count() == 0
    assert pivots.top_k(table(spark, [(0, None), (100, [])])).count() == 0


def test_scores_beyond_doubles(spark):
    """Products over 2^53 are exact, over 2^63 an error."""
    rows = [(i * 50, [float(2**16 + i), float(-(2**15) - 3 * i), float(i)]) for i in range(30)]
    found = sorted(map(tuple, pivots.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scale=512).collect()))
    x = {i: [int(512 * c) for c in v] for i, v in rows}
    assert len(found) == 150 and max(r[3] for r in found) > 2**50
    for q, _, v, s in found:
        assert s == sum(a * b for a, b in zip(x[q], x[v]))
    with pytest.raises(ArithmeticError):
        pivots.top_k(spark.createDataFrame([(0, [1e12, 1.0])], "vec_id bigint, embedding array<double>"))


def test_far_chunks_are_not_read(spark):
    """In well-parted groups the cells of the second pass are few: thresholds rule the others out."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.eye(8)[i % 8] * 4 + rng.normal(0, 0.05, 8)]) for i in range(1600)]
    whole = [np.floor(1024 * np.array(v)).astype(np.int64) for _, v in rows]
    x = np.stack(whole)
    chosen = pivots.farthest_first(x, 8)
    chunks = []
    for g in range(8):
        t = pivots.distances(x[g::8], chosen)
        chunks.append({"block": g, "low": t.min(0).tobytes(), "high": t.max(0).tobytes(), "top": float((x[g::8] ** 2).sum(1).max())})
    q = x[:8]
    pack = {"table": np.ascontiguousarray(pivots.distances(q, chosen).T), "norms": (q**2).sum(1).astype(float)}
    bounds = pivots.chunk_bounds({k: v.tobytes() for k, v in pack.items()}, chunks, 8)
    scores = q @ x.T
    kth = np.sort(scores, axis=1)[:, -11]
    assert (bounds >= kth[:, None]).sum() <= 16
    for g in range(8):
        assert (bounds[:, g] >= scores[:, g::8].max(axis=1)).all()


def plain_whitening(rows, width=6, scale=64):
    whole = [(i, np.floor(scale * v).astype(np.int64) + 1_000_000) for i, v in usable(rows, width)]
    fit = np.unique(np.stack([x for _, x in whole]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    mean = sums / n
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    return whole, n, sums, mean, values[::-1], axes[:, ::-1]


def test_whitening(spark, troubled):
    found = whitening.whiten(table(spark, troubled))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.collect()
    whole, n, sums, mean, values, axes = plain_whitening(troubled)
    assert len(rows) == 6 * len(whole) and {r.n for r in rows} == {n}
    want = sorted(((i, int(((n * x - sums) ** 2).sum())) for i, x in whole for _ in range(6)), key=str)
    assert sorted(((r.vec_id, r.deviation) for r in rows), key=str) == want
    by = {(r.vec_id, r.component): r for r in rows}
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-10
    for c in range(1, 7):
        plain = {i: float((x - mean) @ axes[:, c - 1]) / math.sqrt(values[c - 1]) for i, x in whole if i is not None and i != 100}
        sign = math.copysign(1, sum(by[i, c].whitened * w for i, w in plain.items()))
        assert max(abs(by[i, c].whitened - sign * w) for i, w in plain.items()) < 1e-8
        assert by[0, c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)


def test_whitening_of_many_parts_equals_that_of_one(spark):
    rows = random_rows(3000, 20, 5)
    many = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, rows, 40)).collect()}
    whole, n, sums, mean, values, axes = plain_whitening(rows, 20)
    assert len(many) == 16 * 3000
    for c in (1, 8, 16):
        plain = np.array([(x - mean) @ axes[:, c - 1] for _, x in whole]) / math.sqrt(values[c - 1])
        got = np.array([many[i, c].whitened for i, _ in whole])
        assert min(np.abs(got - plain).max(), np.abs(got + plain).max()) < 1e-8


def test_directions_without_variance(spark):
    """Columns that repeat each other: null where nothing varies, and the others as they are."""
    rows = [(i, [float(i % 7), float(i % 7), 1.0]) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r.component for r in found if r.whitened is None} == {2, 3}
    assert all(r.explained == pytest.approx(1.0) for r in found if r.component == 1) and all(r.identity_error < 1e-12 for r in found)
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one) == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [])], [(None, [None])]):
        found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
        assert found.columns[0] == "vec_id" and found.count() == 0


def test_large_numbers_stay_exact(spark):
    """Deviations over 2^63 are null, sums beyond a long are exact."""
    rows = [(i, [float(2**54 + i * 2**20), float(i)]) for i in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).where("component = 1").collect()
    x = [[int(64 * v[0]) + 1_000_000, int(64 * v[1]) + 1_000_000] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    for r in found:
        exact = sum((40 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert r.deviation == (exact if exact < 2**63 else None)


def test_tree_merges_in_small_groups(spark):
    parts = spark.range(1000).select(F.col("id").alias("part_"), F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("most"))
    merge = lambda found: {"n": sum(r["n"] for r in found), "most": max(len(found), *(r["most"] for r in found))}
    assert vectors.tree_merged(parts, merge, "sums") == {"part_": 0, "n": 1000, "most": vectors.FAN}
    assert vectors.tree_merged(parts.limit(0), merge, "sums") is None
