"""What the query modules share: the registry's decorator and the tables' stand-ins for clips, runs and ratings.

The driver's tables are not audio. A document stands for a clip with its transcript (source: speaker, lang: style); columns
that only audio has are fixed expressions of its id and length, the same text in both engines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.operators.components import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator's id, with the SQL that must give the same rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder for files that a query writes and reads again."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLIP = [
    "doc_id",
    "source AS speaker",
    "lang AS style",
    "text",
    "n_chars",
    "concat(source, '_', lang, '_', lpad(cast(doc_id AS string), 6, '0')) AS stem",
    "CASE WHEN doc_id % 3 = 0 THEN 'base' ELSE 'longform' END AS corpus",
    "CASE WHEN doc_id % 5 = 0 THEN 'emphasis' WHEN doc_id % 5 = 1 THEN 'essentials' END AS substyle",
    "CASE WHEN doc_id % 41 = 0 THEN 'unreadable' END AS error",
    "cast(CASE WHEN doc_id % 17 = 0 THEN 2 ELSE 1 END AS int) AS channels",
    "cast(n_chars AS double) / (60 + doc_id % 7) AS duration_s",
    "cast(doc_id % 7 AS double) / 5000 AS clipping_fraction",
    "cast(doc_id % 29 AS double) / 20000 AS peak",
    "-70e0 + doc_id % 23 AS noise_floor_dbfs",
    "-30e0 + doc_id % 11 AS speech_level_dbfs",
    "0.5e0 + cast(doc_id % 9 AS double) / 20 AS active_fraction",
    "CASE WHEN doc_id % 4 <> 0 THEN 90e0 + doc_id % 97 END AS f0_median_hz",
    "CASE WHEN doc_id % 4 <> 0 THEN 2e0 + doc_id % 13 END AS f0_range_st",
    "cast(doc_id % 10 AS double) / 12 AS voiced_fraction",
]
CLIPS = "clips AS (SELECT " + ", ".join(CLIP) + " FROM documents)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*CLIP)


RUN = [
    "conv_id",
    "turn",
    "concat('run', cast(conv_id % 3 AS string)) AS run",
    "role AS style",
    "conv_id AS item_id",
    "turn AS seed",
    "text",
    "length(text) AS chars",
    "cast(length(text) AS double) / 14 AS duration_s",
    "cast((conv_id * 7 + turn * 3) % 10 AS double) / 10 AS arousal",
    "cast((conv_id * 5 + turn * 11) % 10 AS double) / 10 AS voicing",
]
RUNS = "runs AS (SELECT " + ", ".join(RUN) + " FROM conversations)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*RUN)


#: RE2's and Java's classes spelled out, so that both engines see the same words.
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[''`‘’]', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm(column: str) -> str:
    return NORM.format(column)
