"""Quality gates, usable clips, and checks of claims against measured styles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import strip_emphasis

ISSUE = "array<struct<code:string,detail:string>>"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the gates; a value on the boundary passes."""

    min_duration_s: float = 1.0
    max_duration_s: float = 30.0
    max_clipping_fraction: float = 0.001
    min_peak: float = 0.001
    max_text_chars: int = 400


def issue(condition: Column, code: str, detail: Column) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))


def quality_issues(limits: Limits = Limits(), text: str = "text") -> Column:
    """Ordered issues of a measured clip (error, channels, duration_s, clipping_fraction, peak) and its transcript. An error
    hides all others."""
    t, d = F.col(text), F.col("duration_s")

    def text_issue(clean: Column) -> Column:  # bound once: the stripped text is not computed anew for each rule
        return F.coalesce(
            issue(t.isNull(), "no_transcript", F.lit("no transcript line")),
            issue(clean == 0, "empty_transcript", F.lit("transcript is empty")),
            issue(clean > limits.max_text_chars, "text_too_long", F.concat(F.length(t).cast("string"), F.lit(" characters"))),
        )

    found = F.array(
        issue(~F.col("channels").eqNullSafe(1), "not_mono", F.concat(F.coalesce(F.col("channels").cast("string"), F.lit("None")), F.lit(" channels"))),
        issue(d < limits.min_duration_s, "too_short", F.format_string(f"%.2fs < {limits.min_duration_s}s", d)),
        issue(d > limits.max_duration_s, "too_long", F.format_string(f"%.2fs > {limits.max_duration_s}s", d)),
        issue(F.col("clipping_fraction") > limits.max_clipping_fraction, "clipping", F.format_string("%.4f%% of samples at full scale", F.col("clipping_fraction") * 100)),
        issue(F.col("peak") < limits.min_peak, "near_silent", F.concat(F.lit("peak "), F.col("peak").cast("string"))),
        F.element_at(F.transform(F.array(F.length(strip_emphasis(t))), text_issue), 1),
    )
    rest = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.col("error").isNotNull(), F.array(issue(F.lit(True), "corrupt", F.col("error")))).otherwise(rest)


def with_style_issue(issues: Column, style: Column, known: list[str]) -> Column:
    """An issue more for a style that is not read speech."""
    return F.concat(issues, F.when(style.isNull() | ~style.isin(known), F.array(issue(F.lit(True), "not_read_style", F.coalesce(style, F.lit("None"))))).otherwise(F.array().cast(ISSUE)))


def usable(issues: Column) -> Column:
    return F.size(issues) == 0


def candidates(styles: list[str], corpora: list[str], barred: list[str]) -> Column:
    """Which clips come into question; a missing substyle is never barred."""
    sub = F.col("substyle")
    return F.col("style").isin(styles) & F.col("corpus").isin(corpora) & (sub.isNull() | ~sub.isin(barred))


def issue_histogram(df: DataFrame, issues: str = "issues", keys: tuple[str, ...] = ()) -> DataFrame:
    one = df.select(*keys, F.explode(issues).alias("issue"))
    return one.groupBy(*keys, F.col("issue.code").alias("code")).agg(F.count("*").alias("clips"))


def complete_rating(*answers: str) -> Column:
    """All answers are given."""
    out = F.lit(True)
    for a in answers:
        out = out & (F.coalesce(F.col(a), F.lit("")) != "")
    return out


@dataclass(frozen=True)
class ClaimLimits:
    """Fixed values of the claim checks."""

    floor_median_dbfs: float = -55.0
    floor_p95_dbfs: float = -45.0
    least_snr_db: float = 20.0
    subdued_indicators: int = 3
    voiced: float = 0.25
    same_pace: tuple[float, float] = (0.85, 1.15)
    slow_pace: float = 0.75


STYLE_MEASURES = ("noise_floor_median_dbfs", "noise_floor_p95_dbfs", "speech_level_dbfs", "active_fraction", "chars_per_active_s", "f0_median_hz", "f0_range_st", "voiced_fraction")


def style_profile(clips: DataFrame, keys: tuple[str, ...] = ("speaker", "style")) -> DataFrame:
    """Medians (and the floor's lower-rank 95th percentile) per style; nulls are skipped."""
    from loomline.functions.stats import order_statistics

    wanted = {"noise_floor_median_dbfs": ("noise_floor_dbfs", 0.5), "noise_floor_p95_dbfs": ("noise_floor_dbfs", 0.95), **{c: (c, 0.5) for c in STYLE_MEASURES[2:]}}
    found = order_statistics(clips, list(keys), wanted, ("noise_floor_p95_dbfs",))
    rounded = [F.round(m, 2 if m == "noise_floor_p95_dbfs" else 3).alias(m) for m in STYLE_MEASURES]
    counts = clips.groupBy(*keys).agg(F.count("*").alias("clips"), F.count("voiced_fraction").alias("pitch_clips_measured"))
    return counts.join(found.select(*keys, *rounded), list(keys), "left")


def claim_checks(profile: DataFrame, styles: list[str], own_recording: list[str], limits: ClaimLimits = ClaimLimits()) -> DataFrame:
    """(speaker, claim, verdict) for every claim that the speaker's styles allow to be checked."""
    pivoted = profile.groupBy("speaker").pivot("style", styles).agg(*[F.first(m, ignorenulls=True).alias(m) for m in STYLE_MEASURES])
    v = lambda style, m: F.col(f"`{style}_{m}`")
    verdict = lambda ok: F.when(ok, "supported").otherwise("NOT supported")
    has = set(styles)
    claims: list[tuple[str, Column, Column]] = []  # claim, applies, verdict
    for s in styles:
        median, p95 = v(s, "noise_floor_median_dbfs"), v(s, "noise_floor_p95_dbfs")
        if s in own_recording:
            ok = (median > limits.floor_median_dbfs) & (F.round(v(s, "speech_level_dbfs") - median, 1) >= limits.least_snr_db)
        else:
            ok = (median <= limits.floor_median_dbfs) & (p95 <= limits.floor_p95_dbfs)
        claims.append((f"{s}: recording", median.isNotNull(), verdict(ok)))
    if {"default", "sad"} <= has:
        lower = [F.coalesce((v("sad", m) < v("default", m)).cast("int"), F.lit(0)) for m in ("speech_level_dbfs", "f0_median_hz", "f0_range_st", "chars_per_active_s", "active_fraction")]
        claims.append(("sad: subdued", F.lit(True), verdict(sum(lower[1:], lower[0]) >= limits.subdued_indicators)))
        claims.append(("default: animated", F.lit(True), F.lit("label only")))
    if {"default", "whisper"} <= has:
        voiced, base = v("whisper", "voiced_fraction"), v("default", "voiced_fraction")
        claims.append(("whisper: no pitch", voiced.isNotNull() & base.isNotNull(), verdict((voiced < limits.voiced) & (voiced < base / 2))))
        claims.append(("whisper: soft", F.lit(True), verdict(v("whisper", "speech_level_dbfs") < v("default", "speech_level_dbfs"))))
        pace = v("whisper", "chars_per_active_s") / v("default", "chars_per_active_s")
        claims.append(("whisper: moderate speed", F.lit(True), verdict(pace.between(*limits.same_pace))))
        claims.append(("whisper: breathy", F.lit(True), F.lit("label only")))
    if {"default", "enunciated"} <= has:
        pace = v("enunciated", "chars_per_active_s")
        slowest = F.lit(True)
        for s in styles:
            if s != "enunciated":
                slowest = slowest & (pace < v(s, "chars_per_active_s"))
        claims.append(("enunciated: very slow", F.lit(True), verdict((pace / v("default", "chars_per_active_s") < limits.slow_pace) & slowest)))
        if "sad" in has:
            f0, a, b = v("enunciated", "f0_median_hz"), v("sad", "f0_median_hz"), v("default", "f0_median_hz")
            known = f0.isNotNull() & a.isNotNull() & b.isNotNull()
            claims.append(("enunciated: moderate pitch", known, verdict(f0.between(F.least(a, b), F.greatest(a, b)))))
        claims.append(("enunciated: careful", F.lit(True), F.lit("label only")))
    claims.append(("conversational", F.lit(True), F.lit("NOT verifiable")))
    rows = F.array(*[F.when(applies, F.struct(F.lit(name).alias("claim"), said.alias("verdict"))) for name, applies, said in claims])
    return pivoted.select("speaker", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("c")).select("speaker", "c.claim", "c.verdict")


def speaker_ranking(clips: DataFrame, styles: list[str], least_seconds: float, refuted: DataFrame | None = None) -> DataFrame:
    """Speakers by (eligible, least seconds of a style, total seconds), best first; ties by name. Eligible: every style is
    there with enough seconds and no claim is refuted."""
    per_style = clips.where(F.col("style").isin(styles)).groupBy("speaker", "style").agg(F.sum(F.coalesce("duration_s", F.lit(0.0))).alias("seconds"))
    per = per_style.groupBy("speaker").agg(F.count("*").alias("styles"), F.min("seconds").alias("least"), F.sum("seconds").alias("total"))
    ok = (F.col("styles") == len(styles)) & (F.col("least") >= least_seconds)
    if refuted is not None:
        bad = refuted.where("verdict = 'NOT supported'").select("speaker").distinct().withColumn("refuted", F.lit(True))
        per = per.join(bad, "speaker", "left")
        ok = ok & F.col("refuted").isNull()
    from pyspark.sql import Window

    ranked = per.withColumn("eligible", ok)
    order = Window.orderBy(F.col("eligible").desc(), F.col("least").desc(), F.col("total").desc(), "speaker")
    return ranked.withColumn("place", F.row_number().over(order)).select("place", "speaker", "eligible", "styles", "least", "total")


def select_speaker(ranking: DataFrame, pinned: str | None = None) -> str:
    """The best eligible speaker of a ranking, or the pinned one, who must be eligible. Raises where there is none."""
    good = ranking.where("eligible")
    if pinned is not None:
        if good.where(F.col("speaker") == pinned).isEmpty():
            raise ValueError(f"{pinned} is pinned but not eligible")
        return pinned
    best = good.orderBy("place").first()
    if best is None:
        raise ValueError("no speaker is eligible")
    return best["speaker"]


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows) of every rule: how many rows break it, all rules in one pass. rules: name -> the condition that must hold; null breaks it."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{i}_") for i, c in enumerate(rules.values())])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}_").alias("rows")) for i, n in enumerate(rules)])))


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The same rows; one that breaks a rule ends whatever reads them, with the rule's name."""
    for name, holds in rules.items():
        df = df.where(F.coalesce(holds, F.lit(False)) | F.raise_error(F.lit(f"a row breaks the rule {name!r}")).cast("boolean"))
    return df
