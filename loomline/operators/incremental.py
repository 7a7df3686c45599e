"""Components over rows that keep coming: what is known is contracted, and only new rows are linked.

A component that is known is one node, named by its smallest id. New rows are linked to each other through the keys they share,
and to a node through the keys that the known rows hold: those keys are read once, for a join with the new rows' keys. Rounds
of label propagation then run over the new rows' edges alone, whatever the known rows number. The result is that of a
run over all rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.components import connected_components, cut_lineage


def key_values(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id_col, kind, value): a row for each key of a row that isn't null; values are digests, kinds the keys' places."""
    digest = lambda k: F.unhex(F.md5(F.col(k).cast("string").cast("binary")))
    each = F.array(*[F.struct(F.lit(i).alias("kind"), digest(k).alias("value")) for i, k in enumerate(keys)])
    return rows.select(id_col, F.inline(each)).where("value is not null")


def new_links(values: DataFrame, known: DataFrame, id_col: str, node: str = "node") -> DataFrame:
    """Edges (a, b) of new rows: to the first new row of each value, and to the known nodes that hold the value.

    values: (id_col, kind, value) of the new rows; known: (kind, value, node), read once. Ids and nodes are of one type."""
    heads = cut_lineage(values.groupBy("kind", "value").agg(F.min(id_col).alias("head_")))
    within = values.join(heads, ["kind", "value"]).where(F.col(id_col) != F.col("head_")).select(F.col(id_col).alias("a"), F.col("head_").alias("b"))
    across = known.join(heads, ["kind", "value"]).select(F.col("head_").alias("a"), F.col(node).alias("b")).distinct()
    return within.unionByName(across)


class GroupStore:
    """Components of a growing table, kept in a folder that all executors share.

    `members` (id, root) and `values` (kind, value, root) get a part for each generation and are never rewritten; `moves` (root,
    now) says which roots have become part of another component, and is the only table that each generation writes whole: it has a row
    a root that was ever touched. A generation counts once it is in `commits`, so one that failed is simply made again."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str, keys: list[str]):
        self.spark, self.folder, self.id_col, self.keys = spark, folder.rstrip("/"), id_col, keys

    def last(self) -> int | None:
        """The newest generation that was committed."""
        try:
            return self.spark.read.schema("generation int").parquet(f"{self.folder}/commits").agg(F.max("generation")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self, table: str, generation: int) -> DataFrame:
        """A table's rows up to a generation; of moves, its own."""
        rows = self.spark.read.parquet(f"{self.folder}/{table}")
        mine = F.col("generation") == generation if table == "moves" else F.col("generation") <= generation
        return rows.where(mine).drop("generation")

    def write(self, df: DataFrame, table: str, generation: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{table}/generation={generation}")

    def commit(self, generation: int) -> None:
        self.spark.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def extend(self, rows: DataFrame) -> int:
        """Add rows; the first ones begin the store. Returns the generation. Ids that are there already are an error."""
        last = self.last()
        generation = 0 if last is None else last + 1
        id_col = self.id_col
        values = cut_lineage(key_values(rows, id_col, self.keys))
        ids = cut_lineage(rows.select(id_col).distinct())
        kind = ids.schema[id_col].dataType
        if last is None:
            known = self.spark.createDataFrame([], "kind int, value binary").withColumn("node", F.lit(None).cast(kind))
            moves = self.spark.createDataFrame([], "x int").select(F.lit(None).cast(kind).alias("root"), F.lit(None).cast(kind).alias("now"))
        else:
            if not self.read("members", last).join(ids, id_col, "left_semi").isEmpty():
                raise ValueError("an extension may only add rows: some ids are already there")
            moves = self.read("moves", last)
            known = resolved(self.read("values", last), moves).withColumnRenamed("root", "node")
        links = cut_lineage(new_links(values, known, id_col))
        found = connected_components(links)
        # Nodes that are no new row are known roots; those under another name now have moved, and what had moved to them moves on.
        touched = cut_lineage(found.join(ids, found["node"] == ids[id_col], "left_anti").where("node <> component"))
        onward = moves.join(touched.select(F.col("node").alias("now"), "component"), "now", "left").select("root", F.coalesce("component", "now").alias("now"))
        labelled = cut_lineage(ids.join(found.withColumnRenamed("node", id_col), id_col, "left").select(id_col, F.coalesce("component", id_col).alias("root")))
        self.write(labelled, "members", generation)
        self.write(values.join(labelled, id_col).groupBy("kind", "value").agg(F.min("root").alias("root")), "values", generation)
        self.write(onward.unionByName(touched.select(F.col("node").alias("root"), F.col("component").alias("now"))), "moves", generation)
        self.commit(generation)
        return generation

    def labels(self) -> DataFrame:
        """(id, group_id) of all rows so far; a group is named g_ and its smallest id."""
        last = self.last()
        if last is None:
            raise ValueError(f"nothing was ever committed to {self.folder}")
        now = resolved(self.read("members", last), self.read("moves", last))
        return now.select(self.id_col, F.concat(F.lit("g_"), F.col("root").cast("string")).alias("group_id"))


def resolved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows with the root that theirs has become."""
    return rows.join(moves, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")

