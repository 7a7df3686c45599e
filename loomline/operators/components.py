"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a round's table holds per file: small graphs don't pay for many tasks and files in every round.
PART_ROWS = 250_000


@lru_cache(maxsize=1)
def own_dir() -> str:
    return tempfile.mkdtemp(prefix="loomline-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. A local master has one machine, whose temp folder will do where
    that is unset; on a cluster each executor would write to its own disk, so there it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return own_dir()


#: Tables written to cut lineage, with the process that wrote them.
WRITTEN: list[tuple[int, str]] = []


@atexit.register
def remove_written() -> None:
    """Tables written to cut lineage go when the process that reads them ends; those in a store without a path stay for its own rules."""
    while WRITTEN:
        process, path = WRITTEN.pop()
        path = re.sub(r"^file:(//)?(?=/)", "", path)
        if process == os.getpid() and path.startswith("/"):
            shutil.rmtree(path, ignore_errors=True)


def cut_lineage(df: DataFrame, name: str = "loop") -> DataFrame:
    """Write df under the shared folder and read it back. The table lasts as long as this process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append((os.getpid(), path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its smallest node.

    Each round hangs every node on the smallest node among itself and its neighbours, follows these to their roots, and draws the edges
    anew between roots: what has found its root takes no further part, so rounds shrink. Then the rounds' tables are joined, last to
    first. The smallest neighbours are pre-aggregated before they are shuffled; stars are not collected."""
    whole = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"))
    left, loops, rounds = whole.where("a <> b"), whole.where("a = b").select(F.col("a").alias("node")), []
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
        parts = hung.count() // PART_ROWS + 1
        # Chains of nodes that hang on each other halve until all point to roots; only nodes that others hang on, and that hang themselves, are asked.
        while True:
            inner = hung.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
            asked = hung.join(inner, "root", "left")
            hung = cut_lineage(asked.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).coalesce(parts))
            over = hung.where("moved").isEmpty()
            hung = hung.select("node", "root")
            if over:
                break
        rounds.append(hung)
        to = lambda side: hung.where("node <> root").select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))  # noqa: B023, E731
        drawn = left.join(to("a"), "a", "left").select(F.coalesce("a_root", "a").alias("a"), "b").distinct()
        drawn = drawn.join(to("b"), "b", "left").select("a", F.coalesce("b_root", "b").alias("b")).where("a <> b")
        left = cut_lineage(drawn.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if left.isEmpty():
            break
    labels = rounds.pop().withColumnRenamed("root", "component")
    while rounds:
        later = labels.select(F.col("node").alias("root"), "component")
        labels = rounds.pop().join(later, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    alone = loops.distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    return cut_lineage(labels.unionByName(alone))
