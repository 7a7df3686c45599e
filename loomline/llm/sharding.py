"""K-d tree partitioning into shards of near equal bytes, with DataFrame functions only.

The target is the bytes of all rows over the number of shards (or a number of bytes that is given, which then sets the number
of shards). A node that holds k > 1 times the target is split along its widest metadata dimension at the weighted quantile that
leaves floor(k/2)/k of its bytes on one side, until leaves reach the target. Width is relative to the whole table: of a number its
range on a logarithmic scale, of other values the logarithm of how many there are. A quantile is found by histograms over
the key's bits: every pass sums the bytes of 4,096 equal key ranges for all open nodes at once and goes on inside the range
that holds the quantile, so a pass shuffles only partial sums and the driver sees at most 4,096 rows a node.

Equal texts are a group: they take the group's smallest dimensions for their own, and keys are a dimension's code followed by
the text's checksum, so a group lies together in every order. A group of up to WHOLE of a shard is never cut; a heavier one is,
wherever balance asks for it, by a hash of the id and a hash of the row.

Cases: null texts and ids, empty texts and null metadata are ordinary values; a very long text is one row, whatever its size, so
its shard may outweigh the target; ties on a key go the same way; repeated rows are separate rows; fewer rows than shards
leave shards empty; an empty table gives an empty result; only the id, the text and the dimensions are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import written

#: Bits of a key: a dimension's code, the checksum, the id's hash, the row's hash.
CODE, CRC, ID, ROW = 14, 20, 14, 14
TAIL = CRC + ID + ROW
#: Bits below a dimension and a text.
GROUPED = ID + ROW
STEP = 12
#: A key range that holds less than this share of a shard is not refined further.
FINE = 0.0005
#: Groups of equal texts of up to this share of a shard stay whole.
WHOLE = 0.05


@dataclass(eq=False)
class Node:
    first: int  # its first shard
    leaves: int
    dim: str = ""
    cut: int = -1  # keys up to this go left
    sides: list[Node] = field(default_factory=list)

    def open(self) -> list[Node]:
        if self.sides:
            return [n for s in self.sides for n in s.open()]
        return [self]


def is_number(df: DataFrame, column: str) -> bool:
    kind = dict(df.dtypes)[column]
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def code(df: DataFrame, column: str) -> Column:
    """A dimension's 14-bit code: numbers by logarithm, other values by hash."""
    if is_number(df, column):
        scaled = F.floor(F.log2(F.greatest(F.col(column).cast("double"), F.lit(0.0)) + 1) * 256)
        value = F.least(scaled, F.lit((1 << CODE) - 1))
    else:
        value = F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1 << CODE))
    return F.coalesce(value, F.lit(0)).cast("bigint")


def key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TAIL) + F.col("tail_")


def route(node: Node, leaf) -> Column:
    """Nested conditions that lead a row to its open node; leaf: the value there."""
    if not node.sides:
        return leaf(node)
    left, right = (route(s, leaf) for s in node.sides)
    return F.when(key(node.dim) <= node.cut, left).otherwise(right)


def spread(numeric: bool, dim: str) -> Column:
    """How far a dimension's codes reach: see `width`."""
    return (F.max(dim) - F.min(dim) if numeric else F.approx_count_distinct(dim) - 1).alias(f"spread_{dim}")


def width(numeric: bool, of: int, whole: int) -> float:
    """A spread relative to that of the whole table."""
    return 0.0 if not whole else of / whole if numeric else math.log1p(of) / math.log1p(whole)


def split_level(slim: DataFrame, root: Node, dims: dict[str, bool], whole: dict[str, int], target: float, fine: float) -> bool:
    """Split every open node that stands for more than one shard; False: there is none left. dims: name -> whether it is numeric."""
    nodes = [n for n in root.open() if n.leaves > 1]
    if not nodes:
        return False
    ends = [spread(numeric, c) for c, numeric in dims.items()]
    stats = {r["node_"]: r for r in slim.groupBy(route(root, lambda n: F.lit(n.first)).alias("node_")).agg(F.sum("size").alias("bytes_"), *ends).collect()}
    search = {}
    for n in nodes:
        r = stats.get(n.first)
        wide = lambda c: width(dims[c], r[f"spread_{c}"], whole[c])  # noqa: E731, B023
        n.dim = max(dims, key=wide) if r else next(iter(dims))
        total = r["bytes_"] if r else 0
        search[n.first] = {"low": 0, "bits": CODE + TAIL, "before": 0, "goal": total * (n.leaves // 2) / n.leaves, "most": fine * total / n.leaves}
        if not r:
            n.cut, search[n.first]["bits"] = 0, -1
    while left := [n for n in nodes if search[n.first]["bits"] >= 0 and n.cut < 0]:
        at = [search[n.first] for n in left]
        # One pass stops at the bits that tell groups of equal texts apart.
        shift = {n.first: max(GROUPED if s["bits"] > GROUPED else 0, s["bits"] - STEP) for n, s in zip(left, at)}

        def bucket_of(n: Node) -> Column:
            if n not in left:
                return F.lit(None).cast("bigint")
            s, k = search[n.first], key(n.dim)
            inside = (k >= F.lit(s["low"])) & (k < F.lit(s["low"] + (1 << s["bits"])))
            return F.when(inside, F.shiftright(k - F.lit(s["low"]), shift[n.first]) + F.lit(n.first << (STEP + 1)))

        sums = slim.groupBy(route(root, bucket_of).alias("bucket_")).agg(F.sum("size").alias("bytes_"), F.count("*").alias("rows_"))
        found: dict[int, list] = {n.first: [] for n in left}
        for r in sums.collect():  # at most 2^STEP rows for each open node
            if r["bucket_"] is not None:
                found[r["bucket_"] >> (STEP + 1)].append((r["bucket_"] & ((1 << (STEP + 1)) - 1), r["bytes_"], r["rows_"]))
        for n, s in zip(left, at):
            sh = shift[n.first]
            run = s["before"]
            for bucket, size, rows in sorted(found[n.first]):
                if run + size < s["goal"]:
                    run += size
                    continue
                start = s["low"] + (bucket << sh)
                if rows == 1 or sh == 0 or size <= s["most"] or (sh == GROUPED and size <= WHOLE * target):
                    n.cut = start + (1 << sh) - 1 if run + size - s["goal"] <= s["goal"] - run else start - 1
                    n.cut = max(n.cut, 0)
                else:
                    s |= {"low": start, "bits": sh, "before": run}
                break
            else:
                n.cut = s["low"] + (1 << s["bits"]) - 1
    for n in nodes:
        a = n.leaves // 2
        n.sides = [Node(n.first, a), Node(n.first + a, n.leaves - a)]
    return True


def shard_keys(docs: DataFrame, id_col: str, text_col: str, dims: tuple[str, ...], overhead: int) -> tuple[DataFrame, dict[str, bool]]:
    """What the tree needs of every row, written, and the names of its dimensions with whether they are numeric."""
    present = [c for c in dims if c in docs.columns]
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = {f"dim{i}_": is_number(docs, c) for i, c in enumerate(present)} or {"dim0_": True}
    codes = [code(docs, c).alias(n) for c, n in zip(present, names)] or [F.lit(0).cast("bigint").alias("dim0_")]
    base = docs.select(
        F.col(id_col).alias("id_"),
        (F.octet_length(raw) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(raw).alias("crc_"),
        F.xxhash64(raw).alias("text_"),
        *codes,
        F.spark_partition_id().alias("task_"),
        F.monotonically_increasing_id().alias("row_"),
    )
    copies = base.groupBy("text_", "crc_").agg(F.count("*").alias("copies_"), *[F.min(n).alias(f"least_{n}") for n in names]).where("copies_ > 1")
    joined = base.join(copies, ["text_", "crc_"], "left")
    tail = F.shiftleft(F.shiftright("crc_", 32 - CRC), ID + ROW) + F.shiftleft(F.pmod(F.xxhash64("id_"), F.lit(1 << ID)), ROW) + F.pmod(F.xxhash64("row_"), F.lit(1 << ROW))
    keyed = joined.select("id_", "size", "crc_", "task_", "row_", *[F.coalesce(f"least_{n}", n).alias(n) for n in names], tail.alias("tail_"))
    return written(keyed, "shard-keys"), names


def kd_shards(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("lang", "source", "n_chars"),
    overhead: int = 8,
    fine: float = FINE,
    target_bytes: int | None = None,
) -> DataFrame:
    """Shard and slot of every row; sizes are UTF-8 bytes plus `overhead`. With target_bytes there are as many shards as it takes."""
    slim, names = shard_keys(docs, id_col, text_col, dims, overhead)
    top = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_"), *[spread(numeric, n) for n, numeric in names.items()]).first()
    shards = max(1, -(-top["bytes_"] // target_bytes)) if target_bytes else shards
    whole = {n: top[f"spread_{n}"] or 0 for n in names}
    root = Node(0, shards)
    while split_level(slim, root, names, whole, top["bytes_"] / shards, fine):
        pass
    dealt = slim.select("id_", "size", "crc_", "task_", "row_", route(root, lambda n: F.lit(n.first)).alias("shard"))
    nth = F.row_number().over(Window.partitionBy("shard", "task_").orderBy("row_")) - 1
    before = F.sum("rows_").over(Window.partitionBy("shard").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("shard", "task_").agg(F.count("*").alias("rows_")).select("shard", "task_", F.coalesce(before, F.lit(0)).alias("before_"))
    placed = dealt.withColumn("nth_", nth).join(counts, ["shard", "task_"])
    return placed.select(
        F.col("id_").alias(id_col),
        "size",
        F.col("crc_").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth_") + F.col("before_")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
