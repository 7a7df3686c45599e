"""The engine's three whole runs, each as one dictionary of DataFrames that are computed only if they are used."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.align import completeness, trailing_missing, word_errors
from loomline.functions.english import english_kept_words
from loomline.functions.stats import auc, robust_z, spearman
from loomline.functions.text import chars_per_active_second, kept_words, normalize_transcript
from loomline.operators import evaluation, gates, relations, splits
from loomline.operators.components import cut_lineage


@dataclass(frozen=True)
class Choice:
    """What to select from a corpus."""

    styles: tuple[str, ...] = ("default", "sad")
    corpora: tuple[str, ...] = ("base",)
    barred_substyles: tuple[str, ...] = ()
    own_recording: tuple[str, ...] = ()
    least_seconds: float = 0.0
    limits: gates.Limits = gates.Limits()
    ratios: dict[str, float] = field(default_factory=lambda: {"train": 0.8, "validation": 0.1, "test": 0.1})
    seed: int = 1234
    outlier_z: float = 6.0
    least_accepted: int = 100


def inventory(measured: DataFrame, transcripts: DataFrame, official: DataFrame, choice: Choice = Choice(), known_styles: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Clips with issues, findings, group summary, style profile, claims and speaker ranking.

    measured: a row a file with stem, speaker, style, corpus, substyle, sha256 and the audio measures."""
    clips = relations.with_transcripts(measured.drop("text"), transcripts).withColumn("issues", gates.quality_issues(choice.limits))
    if known_styles:
        clips = clips.withColumn("issues", gates.with_style_issue(F.col("issues"), F.col("style"), list(known_styles)))
    clips = cut_lineage(clips.withColumn("norm", normalize_transcript(F.col("text"))))
    finding = lambda df, name: df.select(F.lit(name).alias("finding"), F.col("stem").alias("subject"))
    copies = relations.duplicate_groups(clips, ["sha256"], "stem").select(F.lit("duplicate_audio").alias("finding"), F.col("first_id").alias("subject"))
    again = relations.duplicate_groups(clips.where("norm <> ''"), ["speaker", "style", "norm"], "stem").select(F.lit("repeated_transcript").alias("finding"), F.col("first_id").alias("subject"))
    findings = (
        finding(relations.only_left(clips.select("stem"), transcripts, ["stem"]), "audio_without_transcript")
        .unionByName(finding(relations.only_left(transcripts.select("stem"), clips, ["stem"]), "transcript_without_audio"))
        .unionByName(finding(relations.only_left(official.select("stem"), clips, ["stem"]), "official_not_on_disk"))
        .unionByName(finding(relations.only_left(clips.where(~F.contains("stem", F.lit("longform"))).select("stem"), official, ["stem"]), "on_disk_not_official"))
        .unionByName(copies)
        .unionByName(again)
    )
    wanted = gates.candidates(list(choice.styles), list(choice.corpora), list(choice.barred_substyles))
    good = clips.where(wanted & gates.usable(F.col("issues"))).withColumn("chars_per_active_s", chars_per_active_second(F.col("text"), F.col("duration_s"), F.col("active_fraction")))
    profile = cut_lineage(gates.style_profile(good))
    claims = gates.claim_checks(profile, list(choice.styles), list(choice.own_recording))
    return {
        "clips": clips,
        "findings": findings,
        "issues": gates.issue_histogram(clips),
        "candidates": good,
        "profile": profile,
        "claims": claims,
        "ranking": gates.speaker_ranking(good, list(choice.styles), choice.least_seconds, claims),
    }


#: How far a prepared clip's length (frames) and level (dB) may be off.
LENGTH_OFF, LEVEL_OFF = 2, 0.1


def accept(candidates: DataFrame, choice: Choice = Choice()) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and exclusions (id, style, reasons); every candidate is in one of them. In this order: gates, what preparing has changed
    (where length_error and level_error_db are there), copies, unusual or unknown pace within the style."""
    rows = candidates.withColumn("id", F.col("stem"))
    out = lambda df, *reasons: df.select("id", "style", F.array(*map(F.lit, reasons)).alias("reasons"))
    good = gates.usable(F.col("issues"))
    gated = rows.where(~good).select("id", "style", F.col("issues.code").alias("reasons"))
    off = F.lit(False)
    if {"length_error", "level_error_db"} <= set(candidates.columns):
        off = F.coalesce((F.col("length_error") > LENGTH_OFF) | (F.abs("level_error_db") > LEVEL_OFF), F.lit(True))
    changed = out(rows.where(good & off), "resample_changed")
    marked = cut_lineage(relations.mark_duplicates(rows.where(good & ~off), "sha256", "id"))
    copies = out(marked.where("duplicate_of is not null"), "duplicate_audio")
    rate = marked.where("duplicate_of is null").withColumn("rate", F.try_divide(F.length("text"), F.col("duration_s")))
    scored = cut_lineage(robust_z(rate, ["style"], "rate"))
    outliers = out(scored.where(F.abs("z") > choice.outlier_z), "unusual_pace").unionByName(out(scored.where("z is null"), "unknown_pace"))
    accepted = scored.where(F.abs("z") <= choice.outlier_z).drop("z", "rate", "duplicate_of")
    return accepted, gated.unionByName(changed).unionByName(copies).unionByName(outliers)


def prepare(candidates: DataFrame, choice: Choice = Choice()) -> dict[str, DataFrame]:
    """Accepted examples with leak-free splits, exclusions with reasons, the split report and violated rules (empty if the
    splits hold). candidates: stem, style, text, norm, sha256, duration_s, issues; where they have them, source_file (a group's key,
    too), start_s and end_s (segments of that file), length_error and level_error_db (of the prepared clip)."""
    has = lambda *names: all(c in candidates.columns for c in names)
    accepted, exclusions = accept(candidates, choice)
    n = accepted.count()
    if n < choice.least_accepted:
        raise ValueError(f"only {n} examples were accepted, {choice.least_accepted} are needed")
    keys = ["norm", "sha256", *(["source_file"] if has("source_file") else [])]
    grouped = accepted.join(splits.group_examples(accepted, "id", keys), "id")
    examples = cut_lineage(grouped.join(splits.place_groups(grouped, choice.ratios, choice.seed), "group_id"))
    segments = ("source_file", "start_s", "end_s") if has("source_file", "start_s", "end_s") else None
    return {
        "examples": examples,
        "exclusions": exclusions,
        "report": splits.split_report(examples),
        "violations": splits.verify_splits(examples, choice.ratios, [*keys, "group_id"], segments=segments),
    }


#: How texts become the words of an error rate, by name.
NORMALISERS = {"plain": kept_words, "english": english_kept_words}


def score(scored: DataFrame, rated: DataFrame | None = None, normaliser: str = "english") -> dict[str, DataFrame]:
    """Cells, completeness with intervals and, with ratings, their agreement with the measures.

    scored: run, style, grp, item_id, seed, clip_id, ref, hyp, problem, arousal, voicing, speaker_sim. ref and hyp are texts, which the
    normaliser makes words of, or arrays of words that are taken as they are."""
    to_words = NORMALISERS[normaliser]
    rows = scored
    for side in ("ref", "hyp"):
        if dict(scored.dtypes)[side] == "string":
            rows = rows.withColumn(side, to_words(F.col(side)))
    rows = rows.withColumn("errors", word_errors(F.col("ref"), F.col("hyp"))).withColumn("words", F.size("ref")).withColumn("missing", trailing_missing(F.col("ref"), F.col("hyp")))
    rows = cut_lineage(rows.withColumn("flag", completeness(F.col("missing"), F.col("words"), F.col("problem"), F.col("errors"))))
    out = {
        "clips": rows,
        "cells": evaluation.cell_summary(rows, ["run", "style"], ["arousal", "voicing", "speaker_sim"], "errors", "words"),
        "completeness": evaluation.completeness_table(rows),
        "incomplete": evaluation.rate_table(rows, ["run"], F.col("flag").eqNullSafe("incomplete")),
    }
    if rated is not None:
        joined = cut_lineage(rows.join(rated.where(gates.complete_rating("emotion", "naturalness")), ["run", "clip_id"]))
        sad = joined.withColumn("heard_sad", F.col("emotion") == "sad").withColumn("calm", -F.col("arousal")).withColumn("score", F.col("naturalness").cast("double"))
        out["rated_auc"] = auc(sad, "calm", "heard_sad")
        out["rated_rank"] = spearman(sad, "speaker_sim", "score")
    return out
