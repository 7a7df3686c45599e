"""Queries for projections, filters, scalar functions and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import align, english, text
from loomline.operators import gates
from loomline.plans.base import CLIPS, RUNS, clips, norm, query, runs, table

GATED = (
    f"WITH {CLIPS}, clean AS (SELECT *, trim(regexp_replace(replace(text, '*', ''), '\\s+', ' ', 'g')) AS c FROM clips), flags AS (SELECT *, "
    "CASE WHEN error IS NOT NULL THEN ['corrupt'] ELSE list_filter(["
    "CASE WHEN channels IS DISTINCT FROM 1 THEN 'not_mono' END, CASE WHEN duration_s < 1 THEN 'too_short' END, CASE WHEN duration_s > 30 THEN 'too_long' END, "
    "CASE WHEN clipping_fraction > 0.001e0 THEN 'clipping' END, CASE WHEN peak < 0.001e0 THEN 'near_silent' END, "
    "CASE WHEN text IS NULL THEN 'no_transcript' WHEN length(c) = 0 THEN 'empty_transcript' WHEN length(c) > 400 THEN 'text_too_long' END], lambda x: x IS NOT NULL) END AS codes FROM clean)"
)


def gated(spark, sf_dir):
    return clips(spark, sf_dir).withColumn("issues", gates.quality_issues())


@query("o3_1_parse_stem", f"WITH {CLIPS} SELECT stem, speaker, style, CASE WHEN doc_id < 0 THEN '' END AS substyle, lpad(cast(doc_id AS string), 6, '0') AS number FROM clips")
def o3_1_parse_stem(spark, sf_dir):
    return clips(spark, sf_dir).select("stem", text.parse_stem(F.col("stem")).alias("s")).select("stem", "s.speaker", "s.style", "s.substyle", "s.number")


@query("o3_2_candidates", f"WITH {CLIPS} SELECT stem FROM clips WHERE style IN ('en', 'fr') AND corpus = 'base' AND (substyle IS NULL OR substyle <> 'essentials')")
def o3_2_candidates(spark, sf_dir):
    return clips(spark, sf_dir).where(gates.candidates(["en", "fr"], ["base"], ["essentials"])).select("stem")


@query("o3_3_quality_gates", f"{GATED} SELECT doc_id, array_to_string(codes, ',') AS codes FROM flags")
def o3_3_quality_gates(spark, sf_dir):
    return gated(spark, sf_dir).select("doc_id", F.array_join("issues.code", ",").alias("codes"))


@query("o3_4_read_styles", f"{GATED} SELECT doc_id, array_to_string(CASE WHEN style IN ('en', 'de') THEN codes ELSE list_append(codes, 'not_read_style') END, ',') AS codes FROM flags")
def o3_4_read_styles(spark, sf_dir):
    rows = gated(spark, sf_dir).withColumn("issues", gates.with_style_issue(F.col("issues"), F.col("style"), ["en", "de"]))
    return rows.select("doc_id", F.array_join("issues.code", ",").alias("codes"))


@query("o3_5_usable", f"{GATED} SELECT doc_id, stem FROM flags WHERE len(codes) = 0")
def o3_5_usable(spark, sf_dir):
    return gated(spark, sf_dir).where(gates.usable(F.col("issues"))).select("doc_id", "stem")


@query("o3_6_manifest_projection", f"WITH {CLIPS} SELECT stem, text, speaker, style, round(duration_s, 4) AS duration_s FROM clips")
def o3_6_manifest_projection(spark, sf_dir):
    return clips(spark, sf_dir).select("stem", "text", "speaker", "style", F.round("duration_s", 4).alias("duration_s"))


@query("o3_7_chars_per_active_second", f"WITH {CLIPS} SELECT doc_id, round(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) / greatest(duration_s * active_fraction, 0.1e0), 6) AS pace FROM clips")
def o3_7_chars_per_active_second(spark, sf_dir):
    return clips(spark, sf_dir).select("doc_id", F.round(text.chars_per_active_second(F.col("text"), F.col("duration_s"), F.col("active_fraction")), 6).alias("pace"))


@query(
    "o3_8_duration_filters",
    f"WITH {CLIPS} SELECT doc_id, duration_s BETWEEN 2.5 AND 7 AS listening, duration_s BETWEEN 3 AND 7 AS reference, duration_s > 1 AND duration_s < 30 AS training FROM clips",
)
def o3_8_duration_filters(spark, sf_dir):
    d = F.col("duration_s")
    return clips(spark, sf_dir).select("doc_id", d.between(2.5, 7.0).alias("listening"), d.between(3.0, 7.0).alias("reference"), ((d > 1) & (d < 30)).alias("training"))


PHRASES = {"en": "speaks plainly", "de": "speaks slowly", "fr": "sings", "es": "whispers"}
RECORDING = {"es": "The recording has some noise."}


@query(
    "o3_9_descriptions",
    "SELECT doc_id, source || ' ' || CASE lang WHEN 'en' THEN 'speaks plainly' WHEN 'de' THEN 'speaks slowly' WHEN 'fr' THEN 'sings' ELSE 'whispers' END || '. ' || CASE WHEN lang = 'es' THEN 'The recording has some noise.' ELSE 'The recording is clear.' END AS description FROM documents",
)
def o3_9_descriptions(spark, sf_dir):
    said = text.described(F.col("lang"), F.col("source"), PHRASES, RECORDING, "The recording is clear.")
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("description"))


@query("o3_10_complete_ratings", "SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 3 <> 0")
def o3_10_complete_ratings(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("a", F.when(F.col("quality") == 1, "yes").otherwise("")).withColumn("b", F.when(F.col("doc_id") % 3 != 0, "4"))
    return rows.where(gates.complete_rating("a", "b")).select("doc_id")


@query("o9_1_normalized", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def o9_1_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_transcript(F.col("text")).alias("norm"))


@query("o9_1_normalized_exact", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def o9_1_normalized_exact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_transcript_exact(F.col("text")).alias("norm"))


@query("o9_2_emphasis_stripped", "SELECT doc_id, trim(regexp_replace(replace(text, '*', ''), '\\s+', ' ', 'g')) AS plain FROM documents")
def o9_2_emphasis_stripped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_emphasis(F.col("text")).alias("plain"))


@query("o9_3_stripped_length", "SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chars FROM documents")
def o9_3_stripped_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.stripped_length(F.col("text")).cast("bigint").alias("chars"))


@query(
    "o9_4_display_formats",
    "SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.1f kB', n / 1e3) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1e6) ELSE printf('%.1f GB', n / 1e9) END AS size, "
    "printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS clock FROM (SELECT o_orderkey, o_orderkey * o_orderkey % 7919 * 100003 AS n, o_orderkey % 99991 AS s FROM orders)",
)
def o9_4_display_formats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey * o_orderkey % 7919 * 100003 AS n", "o_orderkey % 99991 AS s")
    return rows.select("o_orderkey", text.human_bytes(F.col("n")).alias("size"), text.hours_minutes_seconds(F.col("s")).alias("clock"))


@query("o9_7_content_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def o9_7_content_hashes(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"))


FINGER = "concat_ws(chr(31), cast(doc_id AS string), text, lang, source)"


@query(
    "o9_8_fingerprint",
    f"WITH h AS (SELECT sha256({FINGER}) AS h FROM documents) SELECT cast(count(*) AS bigint) AS rows, sha256(concat_ws('|', cast(count(*) AS string), "
    + ", ".join(f"cast(sum(cast('0x' || substr(h, {1 + 8 * k}, 8) AS bigint)) AS string)" for k in range(8))
    + ")) AS digest FROM h",
)
def o9_8_fingerprint(spark, sf_dir):
    from loomline.operators.relations import fingerprint

    return fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source"])


@query("o9_9_argmax_first", f"WITH {RUNS} SELECT conv_id, turn, CASE WHEN arousal >= voicing AND arousal >= 0.5e0 THEN 'a' WHEN voicing >= 0.5e0 THEN 'b' ELSE 'c' END AS best FROM runs")
def o9_9_argmax_first(spark, sf_dir):
    scores = F.create_map(F.lit("b"), F.col("voicing"), F.lit("a"), F.col("arousal"), F.lit("c"), F.lit(0.5))
    return runs(spark, sf_dir).select("conv_id", "turn", text.argmax_first(scores, ["a", "b", "c"]).alias("best"))


@query("o9_10_cue_scores", f"WITH {RUNS} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN -arousal WHEN turn % 3 = 1 THEN -voicing END AS cue FROM runs")
def o9_10_cue_scores(spark, sf_dir):
    from loomline.operators.evaluation import cue_score

    style = F.when(F.col("turn") % 3 == 0, "sad").when(F.col("turn") % 3 == 1, "whisper").otherwise("default")
    return runs(spark, sf_dir).select("conv_id", "turn", cue_score(style).alias("cue"))


SIDES = (
    "sides AS (SELECT a.conv_id, a.turn, string_split_regex(trim(a.text), '\\s+') AS r, string_split_regex(trim(b.text), '\\s+') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), "
    # Row i of the alignment table of every pair at once: d is the cost, lead the reference's lead at the last exact match.
    "cells AS (SELECT conv_id, turn, 0 AS i, j, j AS d, cast(0 AS bigint) AS lead FROM (SELECT conv_id, turn, unnest(range(0, len(h) + 1)) AS j FROM sides) UNION ALL "
    "SELECT conv_id, turn, i, j, d, last_value(f IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY j ROWS UNBOUNDED PRECEDING) FROM ("
    "SELECT *, CASE WHEN j = 0 THEN 0 WHEN same THEN i - j WHEN d = diag + 1 THEN diag_lead WHEN d = up + 1 THEN up_lead END AS f FROM ("
    "SELECT *, j + min(CASE WHEN j = 0 THEN i ELSE least(up + 1, diag + CASE WHEN same THEN 0 ELSE 1 END) END - j) OVER (PARTITION BY conv_id, turn ORDER BY j ROWS UNBOUNDED PRECEDING) AS d FROM ("
    "SELECT conv_id, turn, i + 1 AS i, j, d AS up, lead AS up_lead, lag(d) OVER w AS diag, lag(lead) OVER w AS diag_lead, r[i + 1] = h[j] AS same "
    "FROM cells JOIN sides USING (conv_id, turn) WHERE i < len(r) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY j))))), "
    "ends AS (SELECT conv_id, turn, len(r) AS n, len(h) AS m, cells.* EXCLUDE (conv_id, turn) FROM sides JOIN cells USING (conv_id, turn) WHERE i = len(r) AND j = len(h))"
)
ERRORS = f"WITH RECURSIVE {SIDES} SELECT conv_id, turn, cast(d AS int) AS errors FROM ends"


def turn_pairs(spark, sf_dir):
    words = lambda c: F.split(F.trim(c), r"\s+")
    rows = table(spark, sf_dir, "conversations")
    later = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), words("text").alias("h"))
    return rows.select("conv_id", "turn", words("text").alias("r")).join(later, ["conv_id", "turn"])


@query("o9_11_word_errors", ERRORS)
def o9_11_word_errors(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", align.word_errors(F.col("r"), F.col("h")).alias("errors"))


@query("o9_11_word_errors_native", ERRORS)
def o9_11_word_errors_native(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", align.word_errors_native(F.col("r"), F.col("h")).alias("errors"))


@query("o9_12_trailing_missing", f"WITH RECURSIVE {SIDES} SELECT conv_id, turn, cast(greatest(0, n - m - lead) AS int) AS missing FROM ends")
def o9_12_trailing_missing(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", align.trailing_missing(F.col("r"), F.col("h")).alias("missing"))


PROBLEM = "CASE WHEN duration_s < chars / 15e0 * 0.5e0 THEN 'too_short' WHEN duration_s > chars / 15e0 * 2.5e0 + 1 THEN 'too_long' END"


@query(
    "o9_13_completeness",
    f"WITH {RUNS}, m AS (SELECT *, turn % 4 AS missing, conv_id % 9 AS errors, 12 AS words, CASE WHEN conv_id % 6 = 0 THEN 'too_long' WHEN conv_id % 6 = 1 THEN 'cut_off' END AS problem FROM runs) SELECT conv_id, turn, "
    "CASE WHEN missing >= 2 OR (missing >= 1 AND missing / 12e0 >= 1 / 3e0) THEN 'incomplete' WHEN problem = 'too_long' THEN 'check' WHEN problem IS NOT NULL THEN 'incomplete' WHEN errors / 12e0 >= 0.25e0 THEN 'check' END AS flag FROM m",
)
def o9_13_completeness(spark, sf_dir):
    problem = F.when(F.col("conv_id") % 6 == 0, "too_long").when(F.col("conv_id") % 6 == 1, "cut_off")
    return runs(spark, sf_dir).select("conv_id", "turn", align.completeness(F.col("turn") % 4, F.lit(12), problem, F.col("conv_id") % 9).alias("flag"))


@query(
    "o9_14_audio_problems",
    f"WITH {CLIPS} SELECT doc_id, CASE WHEN 10 + doc_id % 31 < 15 THEN 'cut_off' WHEN duration_s * (doc_id % 5) / 2 < n_chars / 60e0 * 0.5e0 THEN 'too_short' WHEN duration_s * (doc_id % 5) / 2 > n_chars / 60e0 * 2.5e0 + 1 THEN 'too_long' END AS problem FROM clips",
)
def o9_14_audio_problems(spark, sf_dir):
    d = F.col("duration_s") * (F.col("doc_id") % 5) / 2
    return clips(spark, sf_dir).select("doc_id", align.audio_problem(F.lit(10) + F.col("doc_id") % 31, d, F.col("n_chars"), F.lit(60.0)).alias("problem"))


@query("o9_15_kept_words", f"SELECT conv_id, turn, cast(len(list_filter(string_split({norm('text')}, ' '), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS int) AS words FROM conversations")
def o9_15_kept_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.kept_words(F.col("text"))).alias("words"))


@query("o9_15_english_errors")
def o9_15_english_errors(spark, sf_dir):
    """Word errors of each turn against the next one, over English words."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", english.english_kept_words("text").alias("w"))
    later = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("h"))
    return rows.join(later, ["conv_id", "turn"]).select("conv_id", "turn", F.size("w").alias("words"), align.word_errors(F.col("w"), F.col("h")).alias("errors"))


@query("o9_16_sentence_pieces")
def o9_16_sentence_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(align.sentence_pieces("text")).alias("nth", "p"))
    return rows.select("conv_id", "turn", "nth", "p.piece", "p.pause")


GROUPS = "CASE turn % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END"


@query("o9_17_item_names", f"SELECT conv_id, turn, {GROUPS} || lpad(cast(conv_id % 100 AS string), 2, '0') AS item_id, {GROUPS} AS grp FROM conversations")
def o9_17_item_names(spark, sf_dir):
    item = text.item_name(F.expr(GROUPS), F.col("conv_id") % 100)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", item.alias("item_id"), text.item_group(item).alias("grp"))


@query("o9_18_run_labels", "SELECT doc_id, lang || '-v' || quality || CASE WHEN toxic = 1 THEN '-smoke' ELSE '' END AS label FROM documents JOIN labels USING (doc_id)")
def o9_18_run_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", text.run_label(F.concat("lang", F.lit("-v"), F.col("quality").cast("string")), F.col("toxic") == 1).alias("label"))


@query(
    "o9_19_levels",
    f"WITH {CLIPS} SELECT doc_id, speech_level_dbfs - noise_floor_dbfs AS snr_db, round(20 * log10(greatest(peak, 1e-10)), 6) AS peak_dbfs, round(12 * log2((f0_median_hz + f0_range_st) / f0_median_hz), 6) AS range_st FROM clips",
)
def o9_19_levels(spark, sf_dir):
    f0 = F.col("f0_median_hz")
    return clips(spark, sf_dir).select(
        "doc_id",
        (F.col("speech_level_dbfs") - F.col("noise_floor_dbfs")).alias("snr_db"),
        F.round(text.decibels(F.col("peak")), 6).alias("peak_dbfs"),
        F.round(text.semitones(f0, f0 + F.col("f0_range_st")), 6).alias("range_st"),
    )


@query("o9_21_frame_cap", f"WITH {CLIPS} SELECT doc_id, cast(least(2580, floor(86 * greatest(3e0, n_chars / 900e0 * 2.5e0 + 1.5e0)) + 10) AS int) AS frames FROM clips")
def o9_21_frame_cap(spark, sf_dir):
    return clips(spark, sf_dir).select("doc_id", text.frame_cap(F.col("n_chars") / 900, 86, 2580).alias("frames"))


@query(
    "o9_22_json_round_trip",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
def o9_22_json_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("again", F.to_json(F.from_json("props", "map<string,string>")))
    return rows.select("event_id", F.get_json_object("again", "$.k").alias("k"))
