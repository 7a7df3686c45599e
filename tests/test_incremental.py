"""Components of growing tables and the placement of groups in runs, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.operators import incremental, splits
from loomline.operators.incremental import GroupStore

from .test_operators import KEYS, RATIOS, SCHEMA, plain_groups

SLIM = "id long, norm string, sha string"


def rows_of(count, seed, start=0):
    rng = random.Random(seed)
    pick = lambda most, sign: None if rng.random() < 0.3 else f"{sign}{rng.randrange(most)}"
    return [(start + i, pick(count * 2, "n"), pick(count, "s")) for i in range(count)]


def plain(rows):
    return plain_groups([(r[0], None, *r[1:]) for r in rows])


def test_parts_give_the_components_of_the_whole(spark, tmp_path):
    """Four parts that merge old components, chains of merges, ids below those before, and rows without keys."""
    store = GroupStore(spark, str(tmp_path / "store"), "id", ["norm", "sha"])
    with pytest.raises(ValueError, match="nothing"):
        store.labels()
    parts = [rows_of(60, 1, 1000), rows_of(50, 2, 500), rows_of(70, 3, 2000), [(1, "n3", "s3"), (2, "n5", "s4"), (3, None, None), (4, "n7", "s3")]]
    known = []
    for n, part in enumerate(parts):
        known += part
        assert store.extend(spark.createDataFrame(part, SLIM).repartition(3)) == n
        assert {r.id: r.group_id for r in store.labels().collect()} == plain(known)
    assert len(set(plain(known).values())) < len(set(plain(parts[0]).values())) + 150
    with pytest.raises(ValueError, match="already"):
        store.extend(spark.createDataFrame([(500, "x", None)], SLIM))


def test_an_empty_part_and_one_hot_key(spark, tmp_path):
    store = GroupStore(spark, str(tmp_path / "store"), "id", ["norm", "sha"])
    store.extend(spark.createDataFrame([], SLIM))
    assert store.labels().count() == 0
    store.extend(spark.createDataFrame([(i, "same" if i % 3 else f"n{i}", None) for i in range(10, 700)], SLIM))
    store.extend(spark.createDataFrame([], SLIM))
    store.extend(spark.createDataFrame([(1, "same", "a"), (2, "n12", "a")], SLIM))
    sizes = {r.group_id: r["count"] for r in store.labels().groupBy("group_id").count().collect()}
    assert sizes["g_1"] == 460 + 1 + 2 and len(sizes) == 229 + 1


def test_a_failed_generation_is_made_again(spark, tmp_path, monkeypatch):
    """Until the commit a generation doesn't count; what it left is written over."""
    store = GroupStore(spark, str(tmp_path / "store"), "id", ["norm", "sha"])
    store.extend(spark.createDataFrame([(1, "a", None), (2, "b", None)], SLIM))
    with monkeypatch.context() as m:
        m.setattr(GroupStore, "commit", lambda self, n: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.extend(spark.createDataFrame([(3, "a", "x"), (4, "b", "x")], SLIM))
    assert {r.id: r.group_id for r in store.labels().collect()} == {1: "g_1", 2: "g_2"}
    assert store.extend(spark.createDataFrame([(5, "b", None)], SLIM)) == 1
    assert {r.id: r.group_id for r in store.labels().collect()} == {1: "g_1", 2: "g_2", 5: "g_2"}


def test_only_new_edges_are_iterated(spark, tmp_path, monkeypatch):
    """Extending by 1 % links only the new rows: rounds see a node or two for each, and old keys are read by one scan."""
    store = GroupStore(spark, str(tmp_path / "store"), "id", ["norm", "sha"])
    old = [(i, f"n{i // 3}", f"s{i // 2}") for i in range(6000)]
    new = [(10_000 + i, f"n{i * 20}", f"fresh{i // 2}") for i in range(60)]
    store.extend(spark.createDataFrame(old, SLIM))
    seen, real = [], incremental.connected_components
    monkeypatch.setattr(incremental, "connected_components", lambda edges, *a, **k: seen.append(edges.count()) or real(edges, *a, **k))
    scans, links = [], incremental.new_links
    monkeypatch.setattr(incremental, "new_links", lambda values, known, *a: scans.append(known._jdf.queryExecution().optimizedPlan().toString()) or links(values, known, *a))
    store.extend(spark.createDataFrame(new, SLIM))
    assert seen[0] <= 4 * len(new)
    assert scans[0].count("value") and scans[0].count("[generation") <= 2
    assert {r.id: r.group_id for r in store.labels().collect()} == plain(old + new)


def fold(groups, ratios, start=None, target=None):
    """The greedy rule, a group after another, in the order of the operator."""
    names = [s for s in splits.SPLITS if s in ratios] + sorted(set(ratios) - set(splits.SPLITS))
    held, out = Counter(start or {}), {}
    for g, brings in groups:
        lack = {s: sum((target[s, k] - held[s, k]) / max(target[s, k], 1e-9) * n for k, n in brings) for s in names}
        best = max(names, key=lambda s: (lack[s], ratios[s]))
        held.update({(best, k): n for k, n in brings})
        out[g] = best
    return out, held


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 5)), min_size=1, max_size=3, unique_by=lambda x: x[0]), st.integers(1, 40)), min_size=1, max_size=6),
    st.sampled_from([{"train": 0.8, "validation": 0.1, "test": 0.1}, {"train": 0.5, "test": 0.5}, {"x": 0.3, "y": 0.3, "train": 0.4}, {"train": 1.0, "test": 0.0}]),
    st.dictionaries(st.sampled_from("abc"), st.integers(0, 60), max_size=3),
)
def test_places_in_a_run_are_those_of_the_fold(runs, ratios, before):
    """Any shapes, counts, ratios and rows held: every group gets the split that the fold gives it."""
    runs = [(sorted(shape), m) for shape, m in runs]
    total = Counter(before)
    for shape, m in runs:
        total.update({k: n * m for k, n in shape})
    shares = splits.Shares(ratios, dict(sorted(total.items())))
    start = {(shares.names[0], k): n for k, n in before.items()}
    target = {(s, k): ratios[s] * n for s in shares.names for k, n in total.items()}
    held = np.array([[start.get((s, k), 0) for k in shares.styles] for s in shares.names], np.int64)
    now = Counter(start)
    for shape, m in runs:
        want, now = fold([(i, shape) for i in range(m)], ratios, now, target)
        numbered = [(shares.styles[k], n) for k, n in shape]
        got = shares.split_of(np.arange(m), numbered, held)
        assert [shares.names[s] for s in got] == [want[i] for i in range(m)]
        some = np.array([m // 2, 0, m - 1])
        assert (shares.split_of(some, numbered, held) == got[some]).all()
        held = shares.after(m, numbered, held)
        assert {(s, k): int(held[i, j]) for i, s in enumerate(shares.names) for k, j in shares.styles.items() if held[i, j]} == {x: n for x, n in now.items() if n}


def test_placement_equals_the_fold(spark, monkeypatch):
    """The whole operator, shapes taken three at a time, against the fold over its order."""
    rng = random.Random(5)
    rows = [(i, rng.choice("ab") if rng.random() < 0.9 else None, f"g_{i if rng.random() < 0.6 else rng.randrange(150)}") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, style string, group_id string")
    members = {}
    for _, style, g in rows:
        members.setdefault(g, Counter())[style] += 1
    import hashlib
    import json

    md5 = lambda *x: hashlib.md5("|".join(("9", *x)).encode()).hexdigest()
    by_name = lambda c: sorted(c.items(), key=lambda kv: str(kv[0]))

    def shape(c):
        nulls_first = sorted(c.items(), key=lambda kv: (kv[0] is not None, kv[0] or ""))
        return json.dumps([({"style": k} if k is not None else {}) | {"n": n} for k, n in nulls_first], separators=(",", ":"))

    order = sorted(members, key=lambda g: (-sum(members[g].values()), md5(shape(members[g])), shape(members[g]), md5(g), g))
    total = Counter(r[1] for r in rows)
    target = {(s, k): RATIOS[s] * n for s in RATIOS for k, n in total.items()}
    want, _ = fold([(g, by_name(members[g])) for g in order], RATIOS, None, target)
    for at_once in (3, 50_000):
        monkeypatch.setattr(splits, "SHAPES_AT_ONCE", at_once)
        assert {r.group_id: r.split for r in splits.place_groups(df, RATIOS, 9).collect()} == want
    assert splits.place_groups(df.limit(0), RATIOS, 9).collect() == []


def test_one_shape_is_spread_over_tasks(spark):
    """40,000 groups of one shape: several tasks place them, and shares are exact."""
    df = spark.range(40_000).select(F.col("id"), F.lit("a").alias("style"), F.concat(F.lit("g_"), F.col("id").cast("string")).alias("group_id"))
    placed = splits.place_groups(df, RATIOS, 3)
    assert {r.split: r["count"] for r in placed.groupBy("split").count().collect()} == {"train": 32_000, "validation": 4_000, "test": 4_000}
    runs = splits.in_runs(splits.shape_text(df.groupBy("group_id", "style").agg(F.count("*").alias("n")), "group_id", "style"), "group_id", 3)
    assert runs.agg(F.countDistinct("nth"), F.min("nth"), F.max("nth")).first()[:] == (40_000, 0, 39_999)


def test_extension_through_chains_of_new_rows(spark):
    """New rows that reach an old group only through each other, and old tables that are torn already."""
    old = spark.createDataFrame([(1, "a", "x", "s1", 1.0, "g_1", "train"), (2, "a", "y", "s2", 1.0, "g_2", "test"), (3, "b", "z", None, 1.0, "g_3", "train")], SCHEMA + ", group_id string, split string")
    new = [(10, "a", "x", "t1", 1.0), (11, "b", "q", "t1", 1.0), (12, "b", "q", "t2", 1.0), (13, "a", "z", "t2", 1.0), (20, "a", None, None, 1.0), (21, "a", "w", "u", 1.0), (9, "a", "w", "v", 1.0)]
    grown = {r.id: (r.group_id, r.split) for r in splits.extend_splits(old, spark.createDataFrame(new, SCHEMA), KEYS, RATIOS, 1).collect()}
    assert [grown[i] for i in (1, 2, 3)] == [("g_1", "train"), ("g_2", "test"), ("g_3", "train")]
    assert {grown[i] for i in (10, 11, 12, 13)} == {("g_1", "train")}
    assert grown[20][0] == "g_20" and grown[21] == grown[9] and grown[9][0] == "g_9"
    with pytest.raises(ValueError, match="two splits, as in g_1"):
        splits.extend_splits(old, spark.createDataFrame([(10, "a", "x", "t", 1.0), (11, "a", "y", "t", 1.0)], SCHEMA), KEYS, RATIOS, 1)
    torn = old.unionByName(spark.createDataFrame([(4, "a", "x", None, 1.0, "g_4", "test")], old.schema))
    with pytest.raises(ValueError, match="already join two splits"):
        splits.extend_splits(torn, spark.createDataFrame(new[4:5], SCHEMA), KEYS, RATIOS, 1)


def test_extension_that_meets_two_splits_and_goes_on(spark):
    """With clash="least" such rows join the first split and group by name; old rows stay, and the rest is as before."""
    old = spark.createDataFrame([(1, "a", "x", "s1", 1.0, "g_1", "train"), (2, "a", "y", "s2", 1.0, "g_2", "test"), (3, "b", "z", None, 1.0, "g_3", "train")], SCHEMA + ", group_id string, split string")
    new = spark.createDataFrame([(10, "a", "x", "t", 1.0), (11, "a", "y", "t", 1.0), (12, "b", "z", "u", 1.0), (13, "b", "v", "w", 1.0)], SCHEMA)
    grown = {r.id: (r.group_id, r.split) for r in splits.extend_splits(old, new, KEYS, RATIOS, 1, clash="least").collect()}
    assert [grown[i] for i in (1, 2, 3)] == [("g_1", "train"), ("g_2", "test"), ("g_3", "train")]
    assert grown[10] == grown[11] == ("g_1", "test") and grown[12] == ("g_3", "train") and grown[13][0] == "g_13" and len(grown) == 7
    with pytest.raises(ValueError, match="clash is"):
        splits.extend_splits(old, new, KEYS, RATIOS, 1, clash="first")
