"""Leak-free stratified splits: groups by shared keys, greedy placement, verification, extension."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.components import connected_components, cut_lineage
from loomline.operators.incremental import key_values, new_links
from loomline.operators.relations import leaks, overlapping_neighbours

SPLITS = ("train", "validation", "test")
#: How far shares may be off, overall and per style.
SHARE_TOLERANCE, STYLE_TOLERANCE = 0.02, 0.04
#: Shapes of groups that one step of the placement takes.
SHAPES_AT_ONCE = 50_000


def group_examples(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, group_id): rows connected by equal non-null values of any key; a group is named g_ and its smallest id.

    Each row is linked to the smallest id of its key's value, so a value with n rows makes n edges, not n squared."""
    # Keys may be long or costly texts: they are read once, as digests.
    slim = cut_lineage(df.select(id_col, *[F.unhex(F.md5(F.col(k).cast("string").cast("binary"))).alias(f"key{i}") for i, k in enumerate(keys)]))
    ids = slim.select(id_col).distinct()
    edges = []
    for i in range(len(keys)):
        with_key = slim.where(f"key{i} is not null").select(F.col(id_col).alias("a"), F.col(f"key{i}").alias("value"))
        edges.append(with_key.join(with_key.groupBy("value").agg(F.min("a").alias("b")), "value").where("a <> b").select("a", "b"))
    linked = connected_components(reduce(DataFrame.unionByName, edges)).withColumnRenamed("node", id_col)
    grouped = ids.join(linked, id_col, "left")
    return grouped.select(id_col, F.concat(F.lit("g_"), F.coalesce("component", id_col).cast("string")).alias("group_id"))


class Shares:
    """How much each split lacks of a shape's styles, and the order in which equal groups go to the splits.

    The i-th group of one shape that a split gets finds it lacking lack(split, i), which falls with i and depends on nothing else
    while groups of that shape are placed. The greedy rule takes the largest of these numbers each time, so the run of a
    shape's groups goes to the splits in the order of all the numbers sorted, and the place of any group in that run can be told
    without the groups before it."""

    def __init__(self, ratios: dict[str, float], total: dict[str, int]):
        self.names = [s for s in SPLITS if s in ratios] + sorted(set(ratios) - set(SPLITS))
        self.ratios = [ratios[s] for s in self.names]
        self.styles = {k: i for i, k in enumerate(total)}
        self.target = np.array([[r * n for n in total.values()] for r in self.ratios]).reshape(len(self.names), len(total))

    def lack(self, split: int, shape: list[tuple[int, int]], held: np.ndarray, i: np.ndarray) -> np.ndarray:
        """What the split lacks of the shape (style, rows) when it holds `held` and i groups of the shape more."""
        out = np.zeros(len(i))
        for k, n in shape:
            t = self.target[split, k]
            out = out + (t - (held[split, k] + i * n)) / max(t, 1e-9) * n
        return out

    def ahead(self, a: int, b: int) -> bool:
        """Whether split a goes before b where they lack as much."""
        return (-self.ratios[a], a) < (-self.ratios[b], b)

    def place_of(self, split: int, i: np.ndarray, shape: list[tuple[int, int]], held: np.ndarray, most: int) -> np.ndarray:
        """Where in the run the split's i-th group stands."""
        mine, place = self.lack(split, shape, held, i), i.copy()
        for other in range(len(self.names)):
            if other != split:
                place = place + first_false(lambda j: self.before(other, j, split, mine, shape, held), np.zeros_like(i), np.full_like(i, most))  # noqa: B023
        return place

    def before(self, other: int, j: np.ndarray, split: int, mine: np.ndarray, shape: list[tuple[int, int]], held: np.ndarray) -> np.ndarray:
        theirs = self.lack(other, shape, held, j)
        return (theirs > mine) | ((theirs == mine) & self.ahead(other, split))

    def given(self, split: int, nth: np.ndarray, shape: list[tuple[int, int]], held: np.ndarray) -> np.ndarray:
        """How many of the run's first nth groups the split gets."""
        most = int(nth.max(initial=0))
        return first_false(lambda i: self.place_of(split, i, shape, held, most) < nth, np.zeros_like(nth), nth.copy())

    def split_of(self, nth: np.ndarray, shape: list[tuple[int, int]], held: np.ndarray) -> np.ndarray:
        """The split (its number) of the run's groups at these places, counted from 0."""
        out, most = np.zeros(len(nth), np.int64), int(nth.max(initial=0)) + 1
        for s in range(len(self.names)):
            out[self.place_of(s, self.given(s, nth, shape, held), shape, held, most) == nth] = s
        return out

    def after(self, count: int, shape: list[tuple[int, int]], held: np.ndarray) -> np.ndarray:
        """What the splits hold when all of a shape's groups are placed."""
        now = held.copy()
        for s in range(len(self.names)):
            got = int(self.given(s, np.array([count], np.int64), shape, held)[0])
            for k, n in shape:
                now[s, k] += got * n
        return now


def first_false(holds, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first number of [low, high] for which `holds` is false, high if there is none; it stays false from there on."""
    while (low < high).any():
        middle = (low + high) // 2
        yes = holds(middle) & (low < high)
        low, high = np.where(yes, middle + 1, low), np.where(yes, high, np.minimum(middle, high))
    return low


def shape_text(counts: DataFrame, group: str, style: str) -> DataFrame:
    """(group, size, shape) from (group, style, n): the shape is the group's styles and their rows, as JSON."""
    pair = F.struct(F.col(style).cast("string").alias("style"), "n")
    return counts.groupBy(group).agg(F.sum("n").alias("size"), F.to_json(F.array_sort(F.collect_list(pair))).alias("shape"))


def in_runs(groups: DataFrame, group: str, seed: int) -> DataFrame:
    """(group, shape, nth): each group's place, from 0, among those of its shape, by a seeded hash. Groups are range-sorted and numbered task
    by task, so a shape may have any number of them."""
    ordered = groups.select(group, "shape", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"))).alias("hash_"))
    by = ["shape", "hash_", group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shape, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = []
            for s in batch.column(1).to_pylist():
                shape, n = (shape, n + 1) if s == shape else (s, 0)
                nth.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names=[group, "shape", "part_", "nth"])

    kind = dict(groups.dtypes)[group]
    numbered = cut_lineage(ordered.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, f"`{group}` {kind}, shape string, part_ int, nth bigint"))
    sizes = numbered.groupBy("shape", "part_").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shape").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shape", "part_", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_"))
    return numbered.join(offsets, ["shape", "part_"]).select(group, "shape", (F.col("nth") + F.col("before_")).alias("nth"))


def place_groups(examples: DataFrame, ratios: dict[str, float], seed: int, have: DataFrame | None = None, group: str = "group_id", style: str = "style") -> DataFrame:
    """(group, split): whole groups, greedily to the split that lacks most of the styles they bring, larger groups first and
    equal sizes in a seeded order. `have`: (split, style, n) already held.

    The seeded order puts groups of one shape (the same styles with as many rows each) in a run. Only shapes are taken one after
    the other, a row each, SHAPES_AT_ONCE in a job that begins with what the one before it left; within a run each group finds
    its split by its place (`Shares`), in as many tasks as there are groups for. The driver holds a count per split and style."""
    counts = examples.groupBy(group, style).agg(F.count("*").alias("n"))
    groups = cut_lineage(shape_text(counts, group, style))
    now: dict[tuple[str, str | None], int] = {}
    if have is not None:
        now = {(r[0], r[1]): r[2] for r in have.groupBy("split", F.col("style").cast("string")).agg(F.sum("n")).collect()}  # splits times styles
    total = {r[0]: r[1] for r in examples.groupBy(F.col(style).cast("string")).count().collect()}  # a row a style
    for (_, k), n in now.items():
        total[k] = total.get(k, 0) + n
    shares = Shares(ratios, dict(sorted(total.items(), key=str)))
    held = np.array([[now.get((s, k), 0) for k in shares.styles] for s in shares.names], np.int64).reshape(shares.target.shape)

    order = [F.desc("size"), F.md5(F.concat_ws("|", F.lit(str(seed)), "shape")), F.col("shape")]
    runs = groups.groupBy("size", "shape").agg(F.count("*").alias("n"))
    steps = -(-runs.count() // SHAPES_AT_ONCE)
    runs = cut_lineage(runs.repartitionByRange(max(1, steps), *order).withColumn("step_", F.spark_partition_id()))
    begun = []
    for (step,) in runs.select("step_").distinct().orderBy("step_").collect():  # a row for SHAPES_AT_ONCE shapes
        mine = runs.where(F.col("step_") == step).coalesce(1).sortWithinPartitions(*order).select("shape", "n")
        begun.append(cut_lineage(mine.mapInArrow(starts_of_runs(shares, held), "shape string, held binary, after binary, at bigint")))
        held = np.frombuffer(begun[-1].orderBy(F.desc("at")).first()["after"], np.int64).reshape(held.shape)
    if not begun:
        return examples.select(group, F.lit(None).cast("string").alias("split")).limit(0)
    starts = reduce(DataFrame.unionByName, begun).select("shape", "held")
    kind = dict(groups.dtypes)[group]
    return in_runs(groups, group, seed).join(starts, "shape").select(group, "shape", "held", "nth").mapInArrow(splits_of_runs(shares, group), f"`{group}` {kind}, split string")


def parsed_shape(text: str, shares: Shares) -> list[tuple[int, int]]:
    """(style's number, rows), in the order of the styles' names."""
    return [(shares.styles[x.get("style")], x["n"]) for x in sorted(json.loads(text), key=lambda x: str(x.get("style")))]


def starts_of_runs(shares: Shares, held: np.ndarray):
    """For shapes (shape, n) in order: what the splits hold when a shape's run begins and when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = held, 0
        for batch in batches:
            rows = []
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                then = shares.after(n, parsed_shape(text, shares), now)
                rows.append((text, now.tobytes(), then.tobytes(), at))
                now, at = then, at + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary(), pa.int64()))], names=["shape", "held", "after", "at"])

    return run


def splits_of_runs(shares: Shares, group: str):
    """The split of each (group, shape, held, nth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shares.names, object)
        for batch in batches:
            codes = batch.column(1).dictionary_encode()
            shape_of, nth = codes.indices.to_numpy(), batch.column(3).to_numpy()
            out = np.empty(len(nth), np.int64)
            for c, text in enumerate(codes.dictionary.to_pylist()):
                at = np.flatnonzero(shape_of == c)
                start = np.frombuffer(batch.column(2)[int(at[0])].as_py(), np.int64).reshape(shares.target.shape)
                out[at] = shares.split_of(nth[at], parsed_shape(text, shares), start)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[out], pa.string())], names=[group, "split"])

    return run


def split_report(df: DataFrame, split: str = "split", style: str = "style") -> DataFrame:
    """Rows and seconds per split and style, with a row (style null) for each split's total."""
    sets = df.groupingSets([[F.col(split), F.col(style)], [F.col(split)]], F.col(split), F.col(style))
    return sets.agg(F.count("*").alias("clips"), F.sum("duration_s").alias("seconds"))


def verify_splits(
    df: DataFrame, ratios: dict[str, float], keys: list[str], id_col: str = "id", split: str = "split", style: str = "style",
    segments: tuple[str, str, str] | None = None, prepared: DataFrame | None = None, path: str = "audio_path",
) -> DataFrame:
    """(check, detail) for every violated rule; empty means that the splits hold. segments: the columns of a row's source file, start and
    end; neighbours of one file may not overlap across splits. prepared: (path) of the files that are there; every row needs its own."""
    rows = lambda d, check, detail: d.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    # Each check reads the rows again: they are made once.
    needed = dict.fromkeys([id_col, split, style, *keys, *(segments or ()), *([path] if prepared is not None else [])])
    df = cut_lineage(df.select(*needed), "verified")
    out = [
        rows(df.groupBy(id_col).count().where("count > 1"), "repeated id", F.col(id_col)),
        rows(df.where(F.col(split).isNull() | ~F.col(split).isin(list(ratios))), "unknown split", F.col(id_col)),
        rows(leaks(df, keys, split), "key in two splits", F.concat_ws("=", "key", "value")),
    ]
    if segments:
        file, start, stop = segments
        pairs = overlapping_neighbours(df.where(F.col(start).isNotNull() & F.col(stop).isNotNull()), file, start, stop, id_col)
        side = df.select(id_col, split).distinct()
        other = side.select(F.col(id_col).alias("next_id"), F.col(split).alias("next_split_"))
        torn = pairs.join(side, id_col).join(other, "next_id").where(~F.col(split).eqNullSafe(F.col("next_split_")))
        out.append(rows(torn, "overlapping segments in two splits", F.concat_ws("/", id_col, "next_id")))
    if prepared is not None:
        out.append(rows(df.join(prepared.select(path).distinct(), path, "left_anti"), "prepared file missing", F.col(id_col)))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv]), F.col(split))
    known = df.where(F.col(split).isin(list(ratios)))
    total = df.agg(F.count("*").alias("all"))
    share = known.groupBy(split).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    out.append(rows(share.where(F.abs(F.col("n") / F.col("all") - wanted) > SHARE_TOLERANCE), "share of split", F.col(split)))
    styles = df.groupBy(style).agg(F.count("*").alias("all"))
    grid = styles.withColumn(split, F.explode(F.array(*map(F.lit, ratios))))
    cells = grid.join(known.groupBy(split, style).agg(F.count("*").alias("n")), [split, style], "left").fillna(0, ["n"])
    out.append(rows(cells.where("n = 0"), "style missing in split", F.concat_ws("/", split, style)))
    out.append(rows(cells.where(F.abs(F.col("n") / F.col("all") - wanted) > STYLE_TOLERANCE), "share of style", F.concat_ws("/", split, style)))
    return reduce(DataFrame.unionByName, out)


def extend_splits(old: DataFrame, new: DataFrame, keys: list[str], ratios: dict[str, float], seed: int, id_col: str = "id", clash: str = "error") -> DataFrame:
    """Old rows unchanged plus the new ones with group_id and split. A component that touches one old split joins it (and the
    old group), one that touches two is an error, the rest are placed with what the old rows hold. `old` has split and
    group_id; new rows whose id is already there are an error.

    With clash="least" the new rows of a component that touches two splits join the first split by name, and the first old group by name.

    An old group is one node: the old rows' keys are read once, and rounds of linking run over the new rows alone. Old rows that share a
    key or a group across two splits are an error too."""
    if not new.join(old.select(id_col), id_col, "left_semi").isEmpty():
        raise ValueError("an extension may only add rows: some ids are already there")
    columns = list(new.columns)
    slim = old.select(F.concat(F.lit("o"), F.col("group_id").cast("string")).alias("node"), "split", *keys)
    ends = [F.min("split").alias("split"), F.max("split").alias("other")]
    known = cut_lineage(key_values(slim.select(F.struct("node", "split").alias("of"), *keys), "of", keys).select("kind", "value", "of.*").groupBy("kind", "value", "node").agg(*ends))
    whole = cut_lineage(slim.groupBy("node").agg(*ends))
    if clash not in ("error", "least"):
        raise ValueError(f"clash is 'error' or 'least', not {clash!r}")
    old_ends = known.groupBy("kind", "value").agg(F.min("split").alias("split"), F.max("other").alias("other")).select("split", "other").unionByName(whole.select("split", "other"))
    if not old_ends.where("split <> other").isEmpty():
        raise ValueError("rows of the old table already join two splits")
    fresh_id = F.concat(F.lit("n"), F.col(id_col).cast("string"))
    found = cut_lineage(connected_components(cut_lineage(new_links(cut_lineage(key_values(new.withColumn("node", fresh_id), "node", keys)), known, "node"))))
    held_by = found.join(whole, "node").groupBy("component").agg(F.min("split").alias("kept_split"), F.max("split").alias("other"), F.min("node").alias("kept"))
    held_by = cut_lineage(held_by)
    torn = held_by.where("kept_split <> other").select("kept").limit(1).collect() if clash == "error" else []
    if torn:
        raise ValueError(f"new rows would join two splits, as in {torn[0][0][1:]}")
    linked = new.withColumn("node", fresh_id).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = linked.join(held_by.drop("other"), "component", "left")
    least = linked.where("kept is null").groupBy("component").agg(F.concat(F.lit("g_"), F.min(id_col).cast("string")).alias("named_"))
    fresh = cut_lineage(linked.join(least, "component", "left").withColumn("group_id", F.coalesce(F.expr("substring(kept, 2)"), "named_")))
    held = old.groupBy("split", "style").agg(F.count("*").alias("n"))
    placed = place_groups(fresh.where("kept is null"), ratios, seed, held).withColumnRenamed("split", "placed_")
    added = fresh.join(placed, "group_id", "left").select(*columns, "group_id", F.coalesce("kept_split", "placed_").alias("split"))
    return old.unionByName(added.select(*columns, "group_id", "split"))
