"""Markdown reports of the whole runs. Each table is an aggregate of a row a speaker, style, run or cell; nothing else comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.stats import order_statistics, with_group
from loomline.functions.text import hours_minutes_seconds
from loomline.operators import gates
from loomline.sinks.files import report

SHARE, NUMBER = ".0%", ".3f"


def hours(seconds: Column) -> Column:
    return hours_minutes_seconds(F.coalesce(seconds, F.lit(0.0)))


def inventory_report(found: dict[str, DataFrame], title: str = "Inventory") -> str:
    """Of workflows.inventory: clips and time per cell, findings, issues, claims and the ranking of speakers."""
    usable = gates.usable(F.col("issues"))
    cells = found["clips"].groupBy("speaker", "style", F.coalesce("substyle", F.lit("-")).alias("substyle")).agg(
        F.count("*").alias("clips"), F.count_if(usable).alias("usable"), hours(F.sum("duration_s")).alias("time"), hours(F.sum(F.when(usable, F.col("duration_s")))).alias("usable time")
    )
    findings = found["findings"].groupBy("finding").count()
    return report(
        title,
        [
            ("Clips", cells.orderBy("speaker", "style", "substyle")),
            ("Findings", findings.orderBy("finding")),
            ("Issues", found["issues"].orderBy("code")),
            ("Measures", found["profile"].orderBy("speaker", "style")),
            ("Claims", found["claims"].orderBy("speaker", "claim")),
            ("Speakers", found["ranking"].orderBy("place").withColumn("least", hours(F.col("least"))).withColumn("total", hours(F.col("total")))),
        ],
    )


def split_table(examples: DataFrame) -> DataFrame:
    """Clips and time per split and style; a split's total comes after its styles."""
    rows = examples.groupingSets([[F.col("split"), F.col("style")], [F.col("split")]], F.col("split"), F.col("style"))
    counted = rows.agg(F.grouping("style").alias("whole_"), F.count("*").alias("clips"), F.sum("duration_s").alias("s_"))
    shown = F.when(F.col("whole_") == 1, "total").otherwise(F.coalesce("style", F.lit("-")))
    return counted.orderBy("split", "whole_", "style").select("split", shown.alias("style"), "clips", hours(F.col("s_")).alias("time"))


def split_report(made: dict[str, DataFrame], title: str = "Splits") -> str:
    """Of workflows.prepare: the splits, exclusions by reason, and violated rules."""
    reasons = made["exclusions"].select(F.explode("reasons").alias("reason")).groupBy("reason").count().orderBy("reason")
    broken = made["violations"].groupBy("check").agg(F.count("*").alias("rows"), F.min("detail").alias("such as")).orderBy("check")
    return report(title, [("Splits", split_table(made["examples"])), ("Excluded", reasons), ("Violated rules", broken)])


def score_report(out: dict[str, DataFrame], title: str = "Scores") -> str:
    """Of workflows.score: a row a run and style, and how ratings and measures agree where there are ratings."""
    medians = {c: NUMBER for c in out["cells"].columns if c.startswith("median_")}
    sections = [("Cells", out["cells"].orderBy("run", "style"))]
    if "rated_auc" in out:
        sections += [("Calm clips heard as sad", out["rated_auc"]), ("Likeness and naturalness", out["rated_rank"])]
    return report(title, sections, {"wer": ".1%", "auc": NUMBER, "rho": "+.2f", **medians})


def completeness_report(out: dict[str, DataFrame], title: str = "Completeness") -> str:
    """Of workflows.score: incomplete clips per group and style, and per run with 95 % limits."""
    return report(title, [("Groups", out["completeness"].drop("place")), ("Runs", out["incomplete"].orderBy("run"))], {"low": ".1%", "high": ".1%"})


def calibration_report(clips: DataFrame, measures: list[str], title: str = "Calibration", style: str = "style") -> str:
    """Medians of the measures by style, over real recordings."""
    counts = clips.groupBy(style).agg(F.count("*").alias("clips"))
    middle = order_statistics(clips, [style], {m: (m, 0.5) for m in measures})
    return report(title, [("Medians", with_group(counts, middle, [style]).orderBy(style))], dict.fromkeys(measures, NUMBER))


def ratings_report(rated: DataFrame, answer: str = "emotion", score: str = "naturalness", title: str = "Ratings") -> str:
    """Shares of each answer and the mean score, per run and style. rated: a row a rating."""
    answers = [r[0] for r in rated.select(answer).where(F.col(answer).isNotNull()).distinct().orderBy(answer).collect()]  # the page's choices
    shares = [(F.count_if(F.col(answer) == a) / F.count("*")).alias(a) for a in answers]
    cells = rated.groupBy("run", "style").agg(F.count("*").alias("ratings"), *shares, F.avg(F.col(score).cast("double")).alias(f"mean {score}"))
    return report(title, [("Answers", cells.orderBy("run", "style"))], {**dict.fromkeys(answers, SHARE), f"mean {score}": ".2f"})

