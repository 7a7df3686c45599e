"""An append-only log of files that were made, resumed exactly once.

The log is a folder of batches, each written whole under its number, and a ledger of the batches that count. A batch that is replayed
finds itself in the ledger and adds nothing; one that died before that is written over. Work is done if the log has its key and
the file it names is there; a file that has gone is made again, and the later row counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class ClipLog:
    """Rows of a fixed schema with a key and the name of a file below `files`, kept in `folder`."""

    def __init__(self, spark: SparkSession, folder: str, files: str, schema: str, key: str = "clip_id", file: str = "file"):
        self.spark, self.folder, self.files, self.schema, self.key, self.file = spark, folder.rstrip("/"), files.rstrip("/"), schema, key, file

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the log; an empty one before it is first written."""
        try:
            return self.spark.read.schema(schema).json(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """(batch, rows) of the batches that count."""
        return self._table("ledger", "batch bigint, rows bigint")

    def rows(self) -> DataFrame:
        """The newest row of each key, of the batches that count."""
        every = self._table("batches", f"{self.schema}, batch bigint")
        counted = every.join(self.ledger().select("batch").distinct(), "batch", "left_semi")
        newest = Window.partitionBy(self.key).orderBy(F.desc("batch"))
        return counted.withColumn("nth_", F.row_number().over(newest)).where("nth_ = 1").drop("nth_")

    def listing(self) -> DataFrame:
        """(file) below `files`, by Spark's own listing, which passes over files without a byte: they count as not there. No content is read."""
        try:
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.files)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.file} string")
        below = self.files.split("://")[-1].rstrip("/") + "/"
        return found.select(F.substring_index("path", below, -1).alias(self.file))

    def done(self) -> DataFrame:
        """Keys that the log has and whose file is there."""
        return self.rows().join(self.listing(), self.file, "left_semi").select(self.key)

    def pending(self, work: DataFrame) -> DataFrame:
        """What is left to do: one row of each key that isn't done."""
        return work.join(self.done(), self.key, "left_anti").dropDuplicates([self.key])

    def append(self, work: DataFrame, batch: int, make: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Do what is pending of a numbered batch and log it; returns the rows logged, 0 for a batch that counts already.

        make: makes the files of pending rows and returns the rows to log. It may run again after a failure."""
        if not self.ledger().where(F.col("batch") == batch).isEmpty():
            return 0
        fresh = self.pending(work)
        target = f"{self.folder}/batches/batch={batch}"
        (make(fresh) if make else fresh).write.mode("overwrite").option("ignoreNullFields", "false").json(target)
        n = self.spark.read.schema(self.schema).json(target).count()
        self.spark.createDataFrame([(batch, n)], "batch bigint, rows bigint").coalesce(1).write.mode("append").json(f"{self.folder}/ledger")
        return n

    def follow(self, work: DataFrame, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
        """Append a stream of work, batch by batch, until what is there has been taken."""
        writer = work.writeStream.foreachBatch(lambda df, n: self.append(df, n, make) and None)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
