"""Queries for aggregates, statistics, ratings and vectors."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from loomline.functions import stats
from loomline.functions.text import item_group, normalize_transcript
from loomline.operators import evaluation, gates, relations
from loomline.operators.components import cut_lineage
from loomline.plans.base import CLIPS, RUNS, clips, norm, query, runs, table
from loomline.plans.joins import PAIRS, RATED, pair_rows, rated
from loomline.plans.scalars import GATED, gated


@query(
    "o5_1_inventory_summary",
    f"{GATED}, f AS (SELECT *, len(codes) = 0 AS ok FROM flags) SELECT speaker, style, corpus, coalesce(substyle, '-') AS substyle, cast(count(*) AS bigint) AS clips, cast(count(*) FILTER (WHERE ok) AS bigint) AS usable, "
    "round(sum(coalesce(duration_s, 0)), 1) AS total_s, round(coalesce(sum(duration_s) FILTER (WHERE ok), 0), 1) AS usable_s, array_to_string(list_sort(list_distinct(list(channels))), ',') AS channels, "
    "cast(count(text) AS bigint) AS with_transcript, median(noise_floor_dbfs) AS median_noise_floor_dbfs, cast(sum(len(codes)) AS bigint) AS issues FROM f GROUP BY 1, 2, 3, 4",
)
def o5_1_inventory_summary(spark, sf_dir):
    rows = gated(spark, sf_dir).withColumn("ok", gates.usable(F.col("issues"))).withColumn("substyle", F.coalesce("substyle", F.lit("-")))
    return rows.groupBy("speaker", "style", "corpus", "substyle").agg(
        F.count("*").alias("clips"),
        F.count_if("ok").alias("usable"),
        F.round(F.sum(F.coalesce("duration_s", F.lit(0.0))), 1).alias("total_s"),
        F.round(F.coalesce(F.sum(F.when(F.col("ok"), F.col("duration_s"))), F.lit(0.0)), 1).alias("usable_s"),
        F.array_join(F.sort_array(F.collect_set("channels")), ",").alias("channels"),
        F.count("text").alias("with_transcript"),
        F.median("noise_floor_dbfs").alias("median_noise_floor_dbfs"),
        F.sum(F.size("issues")).alias("issues"),
    )


@query("o5_2_medians", f"WITH {CLIPS} SELECT style, median(f0_median_hz) AS f0, median(n_chars) AS chars FROM clips GROUP BY style")
def o5_2_medians(spark, sf_dir):
    return stats.order_statistics(clips(spark, sf_dir), ["style"], {"f0": ("f0_median_hz", 0.5), "chars": ("n_chars", 0.5)})


@query("o5_3_lower_p95", "SELECT lang, n_chars AS p95 FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i = floor(0.95e0 * (n - 1))")
def o5_3_lower_p95(spark, sf_dir):
    return stats.lower_rank_frame(table(spark, sf_dir, "documents").select("lang", "n_chars"), ["lang"], "n_chars")


@query("o5_4_linear_percentiles", "SELECT lang, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.9), 6) AS p90 FROM documents GROUP BY lang")
def o5_4_linear_percentiles(spark, sf_dir):
    found = stats.order_statistics(table(spark, sf_dir, "documents").select("lang", "n_chars"), ["lang"], {"p10": ("n_chars", 0.1), "p90": ("n_chars", 0.9)})
    return found.select("lang", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


PROFILE = (
    f"{CLIPS}, paced AS (SELECT *, length(text) / greatest(duration_s * active_fraction, 0.1e0) AS chars_per_active_s FROM clips), "
    "tail AS (SELECT speaker, style, round(noise_floor_dbfs, 2) AS noise_floor_p95_dbfs FROM (SELECT *, row_number() OVER (PARTITION BY speaker, style ORDER BY noise_floor_dbfs) - 1 AS i, count(*) OVER (PARTITION BY speaker, style) AS n FROM paced) WHERE i = floor(0.95e0 * (n - 1))), "
    "profile AS (SELECT speaker, style, cast(count(*) AS bigint) AS clips, round(median(noise_floor_dbfs), 3) AS noise_floor_median_dbfs, any_value(noise_floor_p95_dbfs) AS noise_floor_p95_dbfs, round(median(speech_level_dbfs), 3) AS speech_level_dbfs, "
    "round(median(active_fraction), 3) AS active_fraction, round(median(chars_per_active_s), 3) AS chars_per_active_s, round(median(f0_median_hz), 3) AS f0_median_hz, round(median(f0_range_st), 3) AS f0_range_st, round(median(voiced_fraction), 3) AS voiced_fraction, "
    "cast(count(voiced_fraction) AS bigint) AS pitch_clips_measured FROM paced JOIN tail USING (speaker, style) GROUP BY speaker, style)"
)


def profile(spark, sf_dir):
    pace = F.length("text") / F.greatest(F.col("duration_s") * F.col("active_fraction"), F.lit(0.1))
    return gates.style_profile(clips(spark, sf_dir).withColumn("chars_per_active_s", pace))


@query("o5_5_style_profile", f"WITH {PROFILE} SELECT * FROM profile")
def o5_5_style_profile(spark, sf_dir):
    return profile(spark, sf_dir)


@query("o5_6_speaker_candidates", f"{GATED} SELECT speaker, style, cast(count(*) AS bigint) AS clips, round(sum(duration_s), 1) AS seconds, count(DISTINCT {norm('text')}) AS texts FROM flags WHERE len(codes) = 0 GROUP BY 1, 2")
def o5_6_speaker_candidates(spark, sf_dir):
    good = gated(spark, sf_dir).where(gates.usable(F.col("issues"))).withColumn("norm", normalize_transcript(F.col("text")))
    return good.groupBy("speaker", "style").agg(F.count("*").alias("clips"), F.round(F.sum("duration_s"), 1).alias("seconds"), F.countDistinct("norm").alias("texts"))


@query("o5_7_duplicate_groups", "SELECT sha256(text) AS sha256, cast(count(*) AS bigint) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def o5_7_duplicate_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return relations.duplicate_groups(rows, ["sha256"], "doc_id")


@query("o5_8_split_report", f"WITH {CLIPS}, s AS (SELECT *, cast(doc_id % 3 AS string) AS split FROM clips) SELECT split, style, cast(count(*) AS bigint) AS clips, round(sum(duration_s), 3) AS seconds FROM s GROUP BY GROUPING SETS ((split, style), (split))")
def o5_8_split_report(spark, sf_dir):
    from loomline.operators.splits import split_report

    found = split_report(clips(spark, sf_dir).withColumn("split", (F.col("doc_id") % 3).cast("string")))
    return found.select("split", "style", "clips", F.round("seconds", 3).alias("seconds"))


CLAIMS = (
    f"WITH {PROFILE.replace('documents)', '''(SELECT * REPLACE (CASE lang WHEN 'en' THEN 'default' WHEN 'de' THEN 'sad' WHEN 'fr' THEN 'whisper' ELSE 'enunciated' END AS lang) FROM documents))''')}, "
    "p AS (PIVOT profile ON style IN ('default', 'sad', 'whisper', 'enunciated') USING first(noise_floor_median_dbfs) AS med, first(noise_floor_p95_dbfs) AS p95, first(speech_level_dbfs) AS lev, first(active_fraction) AS act, first(chars_per_active_s) AS pace, "
    "first(f0_median_hz) AS f0, first(f0_range_st) AS rng, first(voiced_fraction) AS voi GROUP BY speaker), "
    "c AS (SELECT speaker, unnest(["
    + ", ".join(
        f"CASE WHEN {s}_med IS NOT NULL THEN {{'claim': '{s}: recording', 'ok': CASE WHEN {cond} THEN 'supported' ELSE 'NOT supported' END}} END"
        for s, cond in [(s, f"{s}_med > -55 AND round({s}_lev - {s}_med, 1) >= 20" if s == "whisper" else f"{s}_med <= -55 AND {s}_p95 <= -45") for s in ("default", "sad", "whisper", "enunciated")]
    )
    + ", {'claim': 'sad: subdued', 'ok': CASE WHEN " + " + ".join(f"coalesce((sad_{m} < default_{m})::int, 0)" for m in ("lev", "f0", "rng", "pace", "act")) + " >= 3 THEN 'supported' ELSE 'NOT supported' END}, {'claim': 'default: animated', 'ok': 'label only'}, "
    "CASE WHEN whisper_voi IS NOT NULL AND default_voi IS NOT NULL THEN {'claim': 'whisper: no pitch', 'ok': CASE WHEN whisper_voi < 0.25e0 AND whisper_voi < default_voi / 2 THEN 'supported' ELSE 'NOT supported' END} END, "
    "{'claim': 'whisper: soft', 'ok': CASE WHEN whisper_lev < default_lev THEN 'supported' ELSE 'NOT supported' END}, "
    "{'claim': 'whisper: moderate speed', 'ok': CASE WHEN whisper_pace / default_pace BETWEEN 0.85e0 AND 1.15e0 THEN 'supported' ELSE 'NOT supported' END}, {'claim': 'whisper: breathy', 'ok': 'label only'}, "
    "{'claim': 'enunciated: very slow', 'ok': CASE WHEN enunciated_pace / default_pace < 0.75e0 AND enunciated_pace < default_pace AND enunciated_pace < sad_pace AND enunciated_pace < whisper_pace THEN 'supported' ELSE 'NOT supported' END}, "
    "CASE WHEN enunciated_f0 IS NOT NULL AND sad_f0 IS NOT NULL AND default_f0 IS NOT NULL THEN {'claim': 'enunciated: moderate pitch', 'ok': CASE WHEN enunciated_f0 BETWEEN least(sad_f0, default_f0) AND greatest(sad_f0, default_f0) THEN 'supported' ELSE 'NOT supported' END} END, "
    "{'claim': 'enunciated: careful', 'ok': 'label only'}, {'claim': 'conversational', 'ok': 'NOT verifiable'}]) AS c FROM p)"
)
STYLES = {"en": "default", "de": "sad", "fr": "whisper", "es": "enunciated"}


def claims(spark, sf_dir):
    pace = F.length("text") / F.greatest(F.col("duration_s") * F.col("active_fraction"), F.lit(0.1))
    style = F.element_at(F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv]), F.col("style"))
    styled = clips(spark, sf_dir).withColumn("chars_per_active_s", pace).withColumn("style", style)
    return gates.claim_checks(gates.style_profile(styled), list(STYLES.values()), ["whisper"])


@query("o5_9_claim_checks", f"{CLAIMS} SELECT speaker, c.claim AS claim, c.ok AS verdict FROM c WHERE c IS NOT NULL")
def o5_9_claim_checks(spark, sf_dir):
    return claims(spark, sf_dir)


@query("o3_11_claim_verdicts", f"{CLAIMS} SELECT c.claim AS claim, c.ok AS verdict, cast(count(*) AS bigint) AS speakers FROM c WHERE c IS NOT NULL GROUP BY 1, 2")
def o3_11_claim_verdicts(spark, sf_dir):
    return claims(spark, sf_dir).groupBy("claim", "verdict").agg(F.count("*").alias("speakers"))


@query("o5_10_issue_histogram", f"{GATED} SELECT code, cast(count(*) AS bigint) AS clips FROM (SELECT unnest(codes) AS code FROM flags) GROUP BY code")
def o5_10_issue_histogram(spark, sf_dir):
    return gates.issue_histogram(gated(spark, sf_dir))


WER = f"{RUNS}, e AS (SELECT *, conv_id % 9 AS errors, 5 + turn % 8 AS words FROM runs)"


def erred(spark, sf_dir):
    return runs(spark, sf_dir).withColumn("errors", F.col("conv_id") % 9).withColumn("words", F.col("turn") % 8 + 5)


@query("o5_11_wer_micro", f"WITH {WER} SELECT run, style, round(sum(errors) / sum(words), 6) AS wer FROM e GROUP BY 1, 2")
def o5_11_wer_micro(spark, sf_dir):
    return erred(spark, sf_dir).groupBy("run", "style").agg(F.round(stats.micro_rate(F.col("errors"), F.col("words")), 6).alias("wer"))


@query("o5_12_confusion", "SELECT quality, cast(count(*) AS bigint) AS n, round(avg((toxic = 0)::int), 6) AS as_0, round(avg((toxic = 1)::int), 6) AS as_1 FROM labels GROUP BY quality")
def o5_12_confusion(spark, sf_dir):
    found = evaluation.confusion(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])
    return found.select("quality", "n", F.round("as_0", 6).alias("as_0"), F.round("as_1", 6).alias("as_1"))


@query("o5_13_cell_summary", f"WITH {WER} SELECT run, style, cast(count(*) AS bigint) AS n, median(arousal) AS median_arousal, median(voicing) AS median_voicing, round(sum(errors) / sum(words), 6) AS wer FROM e GROUP BY 1, 2")
def o5_13_cell_summary(spark, sf_dir):
    return evaluation.cell_summary(erred(spark, sf_dir), ["run", "style"], ["arousal", "voicing"], "errors", "words").withColumn("wer", F.round("wer", 6))


@query("o5_14_paired_shares", f"WITH {PAIRS} SELECT run, cast(count(*) AS bigint) AS pairs, round(avg((value > base)::int), 6) AS greater FROM joint GROUP BY run")
def o5_14_paired_shares(spark, sf_dir):
    found = evaluation.paired_share(pair_rows(spark, sf_dir), ["run", "conv_id", "seed"], "assistant", "user", "duration_s")
    return found.withColumn("greater", F.round("greater", 6))


KEYED = f"{RATED}, keyed AS (SELECT r.*, CASE WHEN d.lang = 'en' THEN 'sad' ELSE 'default' END AS style, d.source AS run FROM rated r JOIN documents d ON d.doc_id = r.label WHERE emotion <> '')"


def keyed(spark, sf_dir):
    key = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), F.when(F.col("lang") == "en", "sad").otherwise("default").alias("style"), F.col("source").alias("run"))
    return rated(spark, sf_dir).where("emotion <> ''").join(key, "label")


@query(
    "o5_15_ratings_summary",
    f"WITH {KEYED} SELECT run, style, cast(count(*) AS bigint) AS n, round(avg((emotion = 'sad')::int), 6) AS share_sad, round(avg((emotion = 'neutral')::int), 6) AS share_neutral, round(avg(naturalness::int), 6) AS mean_naturalness FROM keyed GROUP BY 1, 2",
)
def o5_15_ratings_summary(spark, sf_dir):
    found = evaluation.ratings_summary(keyed(spark, sf_dir), ["run", "style"], "emotion", ["sad", "neutral"], ["naturalness"])
    return found.select("run", "style", "n", *[F.round(c, 6).alias(c) for c in ("share_sad", "share_neutral", "mean_naturalness")])


@query(
    "o5_16_separation",
    f"WITH {KEYED}, s AS (SELECT run, avg((emotion = 'sad')::int) FILTER (WHERE style = 'sad') AS a, avg((emotion = 'sad')::int) FILTER (WHERE style = 'default') AS b FROM keyed GROUP BY run) SELECT run, round((a - b) * 100, 6) AS points FROM s WHERE a IS NOT NULL AND b IS NOT NULL",
)
def o5_16_separation(spark, sf_dir):
    return evaluation.separation(keyed(spark, sf_dir), "run", "style", "emotion", "sad", "default").select("run", F.round("points", 6).alias("points"))


@query("o5_17_answers_crosstab", f"WITH {KEYED} SELECT run, cast(count(*) FILTER (WHERE emotion = 'neutral') AS bigint) AS neutral, cast(count(*) FILTER (WHERE emotion = 'sad') AS bigint) AS sad FROM keyed GROUP BY run")
def o5_17_answers_crosstab(spark, sf_dir):
    return evaluation.answers_crosstab(keyed(spark, sf_dir), ["run"], "emotion")


@query(
    "o5_18_pair_answers",
    "WITH a AS (SELECT l.doc_id AS label, CASE l.doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'same' ELSE '' END AS answer, d.source AS run, CASE WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS side FROM labels l JOIN documents d USING (doc_id)) "
    "SELECT run, cast(count(*) AS bigint) AS pairs, round(avg((answer = side)::int), 6) AS \"right\", round(avg((answer <> 'same' AND answer <> side)::int), 6) AS wrong, round(avg((answer = 'same')::int), 6) AS same FROM a WHERE answer <> '' GROUP BY run",
)
def o5_18_pair_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label")
    answers = rows.select("label", F.element_at(F.array(*map(F.lit, ("A", "B", "same", ""))), (F.col("label") % 4 + 1).cast("int")).alias("answer"))
    sides = rows.select("label", F.when(F.col("quality") == 1, "A").otherwise("B").alias("side"))
    key = sides.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), F.col("source").alias("run")), "label")
    return evaluation.pair_answers(answers, key, "src0").select("run", "pairs", *[F.round(c, 6).alias(c) for c in ("right", "wrong", "same")])


FLAGGED = (
    "flagged AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'test' END AS grp, role AS style, CASE conv_id % 7 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'check' END AS flag FROM conversations)"
)


def flagged(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    item = F.concat(F.expr("CASE turn % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'test' END"), (F.col("conv_id") % 50).cast("string"))
    return rows.select("conv_id", item_group(item).alias("grp"), F.col("role").alias("style"), F.when(F.col("conv_id") % 7 == 0, "incomplete").when(F.col("conv_id") % 7 == 1, "check").alias("flag"))


@query(
    "o5_19_completeness_table",
    f"WITH {FLAGGED} SELECT grp, style, cast(count(*) AS bigint) AS clips, cast(count(*) FILTER (WHERE flag = 'incomplete') AS bigint) AS incomplete, cast(count(*) FILTER (WHERE flag = 'check') AS bigint) AS to_check, cast(CASE grp WHEN 'short' THEN 1 WHEN 'medium' THEN 2 ELSE 4 END AS bigint) AS place FROM flagged GROUP BY grp, style",
)
def o5_19_completeness_table(spark, sf_dir):
    return evaluation.completeness_table(flagged(spark, sf_dir))


WILSON = "round(greatest((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high"


@query(
    "o5_20_wilson",
    f"SELECT source, cast(k AS bigint) AS k, cast(n AS bigint) AS n, {WILSON} FROM (SELECT source, cast(count(*) FILTER (WHERE quality = 1) AS double) AS k, cast(count(*) AS double) AS n, 1.959963984540054e0 AS z FROM labels JOIN documents USING (doc_id) GROUP BY source)",
)
def o5_20_wilson(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    found = evaluation.rate_table(rows, ["source"], F.col("quality") == 1)
    return found.select("source", "k", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "o5_21_measure_table",
    f"WITH {CLIPS} SELECT speaker, style, cast(count(*) AS bigint) AS n, cast(count(error) AS bigint) AS unusable, round(median(duration_s), 6) AS duration_s, round(median(peak), 6) AS peak, cast(count(*) FILTER (WHERE clipping_fraction > 0) AS bigint) AS clipped FROM clips GROUP BY 1, 2",
)
def o5_21_measure_table(spark, sf_dir):
    return clips(spark, sf_dir).groupBy("speaker", "style").agg(
        F.count("*").alias("n"), F.count("error").alias("unusable"), F.round(F.median("duration_s"), 6).alias("duration_s"), F.round(F.median("peak"), 6).alias("peak"), F.count_if(F.col("clipping_fraction") > 0).alias("clipped")
    )


@query("o5_22_duration_ratio", f"WITH {PAIRS} SELECT run, cast(count(*) AS bigint) AS pairs, round(median(value / base), 6) AS median_ratio, round(avg(value / base), 6) AS mean_ratio FROM joint WHERE base > 0 GROUP BY run")
def o5_22_duration_ratio(spark, sf_dir):
    found = evaluation.paired_ratio(pair_rows(spark, sf_dir), ["run", "conv_id", "seed"], "assistant", "user", "duration_s")
    return found.select("run", "pairs", F.round("median_ratio", 6).alias("median_ratio"), F.round("mean_ratio", 6).alias("mean_ratio"))


@query("o5_23_calibration_medians", f"WITH {CLIPS} SELECT style, median(noise_floor_dbfs) AS floor_dbfs, round(median(voiced_fraction), 6) AS voiced FROM clips GROUP BY style")
def o5_23_calibration_medians(spark, sf_dir):
    found = stats.order_statistics(clips(spark, sf_dir), ["style"], {"floor_dbfs": ("noise_floor_dbfs", 0.5), "voiced": ("voiced_fraction", 0.5)})
    return found.withColumn("voiced", F.round("voiced", 6))


@query(
    "o5_24_auc",
    "WITH r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id)), "
    "s AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q, sum(r) FILTER (WHERE quality = 1) AS rs FROM r GROUP BY lang) "
    "SELECT lang, cast(p AS bigint) AS positives, cast(q AS bigint) AS negatives, CASE WHEN p > 0 AND q > 0 THEN round((rs - p * (p + 1) / 2) / (p * q), 6) END AS auc FROM s",
)
def o5_24_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return stats.auc(rows.select("lang", "n_chars", "good"), "n_chars", "good", ("lang",)).withColumn("auc", F.round("auc", 6))


@query(
    "o5_25_spearman",
    "WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS x, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2 AS y FROM documents JOIN labels USING (doc_id)) SELECT cast(count(*) AS bigint) AS n, round(corr(x, y), 6) AS rho FROM r",
)
def o5_25_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return stats.spearman(rows, "n_chars", "quality").select("n", F.round("rho", 6).alias("rho"))


CENTROID = (
    "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) AS v FROM embeddings), "
    "m AS (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label), "
    "c AS (SELECT label, list(x / norm ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY label)"
)


@query("o5_26_centroid_similarity", f"WITH {CENTROID} SELECT vec_id, round(list_dot_product(v, c), 4) AS similarity FROM u JOIN c USING (label)")
def o5_26_centroid_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    near = evaluation.unit_vectors(rows, "embedding").join(evaluation.centroids(rows, ["label"], "embedding"), "label")
    return near.select("vec_id", F.round(evaluation.similarity(F.col("unit"), F.col("centroid")), 4).alias("similarity"))


@query("o5_27_counters", "SELECT cast(count(*) AS bigint) AS seen, cast(count(*) FILTER (WHERE n_chars > 0) AS bigint) AS filled, cast(count(*) FILTER (WHERE lang = 'en') AS bigint) AS english FROM documents")
def o5_27_counters(spark, sf_dir):
    """Counters of an extraction, taken while its rows are written: one pass gives both."""
    found = Observation()
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    counted = docs.observe(found, F.count("*").alias("seen"), F.count_if(F.col("n_chars") > 0).alias("filled"), F.count_if(F.col("lang") == "en").alias("english"))
    kept = cut_lineage(counted.where("n_chars > 0"), "extracted")
    counts = kept.agg(F.count("*").alias("written_"))
    # What was written is read again and must be as many rows as the counter says.
    same = F.when(F.col("written_") == found.get["filled"], F.lit(found.get["filled"])).otherwise(F.raise_error(F.lit("rows and counters differ")).cast("bigint"))
    return counts.select(F.lit(found.get["seen"]).cast("bigint").alias("seen"), same.cast("bigint").alias("filled"), F.lit(found.get["english"]).cast("bigint").alias("english"))


@query("o5_28_real_time_factor", f"WITH {RUNS} SELECT run, round(sum(duration_s) / sum(1 + arousal), 6) AS rtf FROM runs GROUP BY run")
def o5_28_real_time_factor(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("wall_s", F.col("arousal") + 1)
    return evaluation.real_time_factor(rows, ["run"], "duration_s", "wall_s").withColumn("rtf", F.round("rtf", 6))


@query("o5_29_steps_per_epoch", "SELECT source, greatest(1, cast(floor(count(*) / 16) AS bigint)) AS steps FROM documents GROUP BY source")
def o5_29_steps_per_epoch(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(evaluation.steps_per_epoch(F.count("*"), 4, 4).alias("steps"))


@query(
    "o5_30_binomial_tail",
    "WITH g AS (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang, source), "
    "t AS (SELECT lang, source, n, k, unnest(range(k, n + 1)) AS i FROM g) SELECT lang, source, cast(n AS bigint) AS n, cast(k AS bigint) AS k, "
    "round(sum(exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) - n * ln(2e0))), 9) AS p FROM t GROUP BY lang, source, n, k",
)
def o5_30_binomial_tail(spark, sf_dir):
    """How likely it is by chance that so many of a cell's labelled documents are good."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    cells = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    return cells.withColumn("p", F.round(stats.binomial_tail_of(F.col("k"), F.col("n")), 9))


RANKS = (
    f"{GATED}, s AS (SELECT speaker, style, sum(coalesce(duration_s, 0)) AS sec FROM flags WHERE len(codes) = 0 AND style IN ('en', 'fr') GROUP BY 1, 2), "
    "a AS (SELECT speaker, cast(count(*) AS bigint) AS styles, min(sec) AS least, sum(sec) AS total, count(*) = 2 AND min(sec) >= 20 AS eligible FROM s GROUP BY speaker)"
)


def ranked(spark, sf_dir):
    good = gated(spark, sf_dir).where(gates.usable(F.col("issues")))
    return gates.speaker_ranking(good, ["en", "fr"], 20.0)


@query("o5_31_usable_seconds", f"{RANKS} SELECT speaker, round(least, 3) AS least, round(total, 3) AS total FROM a")
def o5_31_usable_seconds(spark, sf_dir):
    return ranked(spark, sf_dir).select("speaker", F.round("least", 3).alias("least"), F.round("total", 3).alias("total"))


@query(
    "o6_4_speaker_ranking",
    f"{RANKS} SELECT cast(row_number() OVER (ORDER BY eligible DESC, least DESC, total DESC, speaker) AS int) AS place, speaker, eligible, styles FROM a",
)
def o6_4_speaker_ranking(spark, sf_dir):
    return ranked(spark, sf_dir).select("place", "speaker", "eligible", "styles")
