"""Model-scored measures behind a pluggable interface, with a content-addressed cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.components import cut_lineage
from loomline.operators.relations import missing_measures


class Scorer(Protocol):
    """A model: loaded once a worker by `load`, then called on batches of file contents."""

    measure: str

    def load(self) -> Callable[[pd.Series], pd.Series]: ...


def scored(files: DataFrame, scorer: Scorer) -> DataFrame:
    """(measure, sha256, value) for every file; value is a JSON string so that all measures share one table."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer.load()
        for batch in batches:
            yield model(batch).astype(str)

    return files.select(F.lit(scorer.measure).alias("measure"), F.sha2("content", 256).alias("sha256"), run("content").alias("value"))


def extend_cache(files: DataFrame, cache: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows to append to the cache: only contents without a value are scored, each once."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    lacking = missing_measures(hashed, cache, scorer.measure)
    return scored(hashed.join(lacking.select("path"), "path", "left_semi"), scorer)


def cached_values(files: DataFrame, cache: DataFrame, measure: str) -> DataFrame:
    """Each file with its cached value, null where there is none."""
    of = cache.where(F.col("measure") == measure).groupBy("sha256").agg(F.max("value").alias(measure))
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content").join(of, "sha256", "left")


class MeasureCache:
    """The cache as a table bucketed by content hash, in a folder that all executors share. Lookups shuffle the files that are asked for to
    the cache's buckets and never the cache; what is new is appended bucket by bucket. The folder outlives the session: another
    one that names it finds the values. The number of buckets is the folder's for good."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.name = spark, "measures_" + md5(folder.encode()).hexdigest()
        columns = "measure STRING, sha256 STRING, value STRING"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY (sha256) SORTED BY (sha256) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def rows(self, measure: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col("measure") == measure)

    def lacking(self, hashed: DataFrame, measure: str) -> DataFrame:
        """One row (sha256, path) of each content that has no value yet. hashed: (sha256, path)."""
        once = hashed.select("sha256", "path").groupBy("sha256").agg(F.min("path").alias("path"))
        return once.join(self.rows(measure).select("sha256").hint("merge"), "sha256", "left_anti")

    def extend(self, files: DataFrame, scorer: Scorer) -> int:
        """Score the contents that have no value, each once, and append them; returns how many. files: (path, content)."""
        lacking = cut_lineage(self.lacking(files.select(F.sha2("content", 256).alias("sha256"), "path"), scorer.measure), "lacking")
        n = lacking.count()
        if n:
            fresh = files.join(lacking.select("path"), "path", "left_semi")
            scored(fresh, scorer).dropDuplicates(["sha256"]).select("measure", "sha256", "value").write.insertInto(self.name)
            self.spark.catalog.refreshTable(self.name)
        return n

    def values(self, hashed: DataFrame, measure: str) -> DataFrame:
        """(sha256, ...) rows with their value, null where there is none."""
        return hashed.join(self.rows(measure).select("sha256", F.col("value").alias(measure)).hint("merge"), "sha256", "left")
