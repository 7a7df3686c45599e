"""Queries for joins, set operations, windows, samples and blinding."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.stats import robust_z
from loomline.functions.text import normalize_transcript
from loomline.operators import evaluation, gates, relations
from loomline.plans.base import CLIP, CLIPS, RUNS, clips, norm, query, runs, table


def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


@query("o4_1_with_transcripts", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def o4_1_with_transcripts(spark, sf_dir):
    return relations.with_transcripts(table(spark, sf_dir, "documents").select("doc_id"), labels(spark, sf_dir).select("doc_id", "quality"), "doc_id")


@query("o4_2_measured_by_key", f"WITH {CLIPS} SELECT c.stem, l.toxic FROM clips c JOIN labels l USING (doc_id)")
def o4_2_measured_by_key(spark, sf_dir):
    return relations.with_measures(clips(spark, sf_dir), labels(spark, sf_dir).select("doc_id", "toxic"), "doc_id").select("stem", "toxic")


@query("o4_3_audio_without_transcript", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def o4_3_audio_without_transcript(spark, sf_dir):
    return relations.only_left(table(spark, sf_dir, "documents").select("doc_id"), labels(spark, sf_dir), ["doc_id"])


@query("o4_4_transcript_without_audio", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def o4_4_transcript_without_audio(spark, sf_dir):
    return relations.only_left(labels(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "documents").where("lang = 'en'"), ["doc_id"])


@query(
    "o4_5_official_and_disk",
    f"WITH {CLIPS} SELECT stem, 'not on disk' AS finding FROM clips WHERE doc_id % 7 = 0 AND stem NOT IN (SELECT stem FROM clips WHERE doc_id % 5 <> 0) "
    "UNION ALL SELECT stem, 'not official' FROM clips WHERE doc_id % 5 <> 0 AND corpus <> 'longform' AND stem NOT IN (SELECT stem FROM clips WHERE doc_id % 7 = 0)",
)
def o4_5_official_and_disk(spark, sf_dir):
    official, disk = clips(spark, sf_dir).where("doc_id % 7 = 0").select("stem"), clips(spark, sf_dir).where("doc_id % 5 <> 0").select("stem", "corpus")
    lost = relations.only_left(official, disk.select("stem"), ["stem"]).withColumn("finding", F.lit("not on disk"))
    extra = relations.only_left(disk.where("corpus <> 'longform'").select("stem"), official, ["stem"]).withColumn("finding", F.lit("not official"))
    return lost.unionByName(extra)


@query("o4_6_reused_measurements", "SELECT l.doc_id, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
def o4_6_reused_measurements(spark, sf_dir):
    return relations.reuse_saved(labels(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


@query("o4_7_pitch_of_accepted", f"WITH {CLIPS} SELECT stem, f0_median_hz FROM clips WHERE f0_median_hz IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def o4_7_pitch_of_accepted(spark, sf_dir):
    accepted = labels(spark, sf_dir).where("quality = 1").select("doc_id")
    return clips(spark, sf_dir).where("f0_median_hz is not null").join(accepted, "doc_id", "left_semi").select("stem", "f0_median_hz")


@query("o4_8_new_by_hash", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def o4_8_new_by_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return relations.only_left(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), ["sha256"]).select("doc_id")


@query("o4_9_rediscovered", f"WITH {CLIPS} SELECT stem FROM clips WHERE doc_id IN (SELECT doc_id FROM labels)")
def o4_9_rediscovered(spark, sf_dir):
    return relations.rediscovered(labels(spark, sf_dir).select("doc_id"), clips(spark, sf_dir), "doc_id").select("stem")


@query("o4_10_eval_absent", f"SELECT item_id FROM benchmark WHERE {norm('text')} NOT IN (SELECT {norm('text')} FROM documents)")
def o4_10_eval_absent(spark, sf_dir):
    key = normalize_transcript(F.col("text")).alias("norm")
    return relations.only_left(table(spark, sf_dir, "benchmark").select("item_id", key), table(spark, sf_dir, "documents").select(key), ["norm"]).select("item_id")


@query("o4_11_reference_examples", "SELECT b.item_id, l.style, l.ref, d.n_chars FROM benchmark b CROSS JOIN (VALUES ('en', 3), ('de', 5)) AS l(style, k), LATERAL (SELECT b.item_id * l.k AS ref) r, documents d WHERE d.doc_id = b.item_id * l.k".replace("l.ref", "b.item_id * l.k AS ref").replace(", LATERAL (SELECT b.item_id * l.k AS ref) r", ""))
def o4_11_reference_examples(spark, sf_dir):
    refs = F.create_map(F.lit("en"), F.col("item_id") * 3, F.lit("de"), F.col("item_id") * 5)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(refs).alias("style", "ref"))
    return items.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), "n_chars"), "ref").select("item_id", "style", "ref", "n_chars")


@query("o4_12_work_list", "SELECT item_id, style, seed FROM benchmark CROSS JOIN (VALUES ('en'), ('de')) s(style) CROSS JOIN (VALUES (11), (22)) t(seed)")
def o4_12_work_list(spark, sf_dir):
    return relations.work_list(table(spark, sf_dir, "benchmark").select("item_id"), ["en", "de"], [11, 22])


@query("o4_13_work_left", "SELECT item_id, style, seed FROM benchmark CROSS JOIN (VALUES ('en'), ('de')) s(style) CROSS JOIN (VALUES (11), (22)) t(seed) WHERE NOT (style = 'en' AND seed = 11 AND item_id % 2 = 0)")
def o4_13_work_left(spark, sf_dir):
    work = relations.work_list(table(spark, sf_dir, "benchmark").select("item_id"), ["en", "de"], [11, 22])
    done = work.where("style = 'en' and seed = 11 and item_id % 2 = 0")
    return relations.only_left(work, done, ["item_id", "style", "seed"])


RATED = "rated AS (SELECT doc_id AS label, CASE WHEN doc_id % 5 = 0 THEN '' WHEN quality = 1 THEN 'sad' ELSE 'neutral' END AS emotion, cast(1 + doc_id % 5 AS string) AS naturalness FROM labels)"


def rated(spark, sf_dir):
    emotion = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("quality") == 1, "sad").otherwise("neutral")
    return labels(spark, sf_dir).select(F.col("doc_id").alias("label"), emotion.alias("emotion"), (F.col("doc_id") % 5 + 1).cast("string").alias("naturalness"))


@query("o4_14_ratings_with_key", f"WITH {RATED} SELECT label, emotion, lang AS style, source AS run FROM rated JOIN documents ON doc_id = label WHERE emotion <> ''")
def o4_14_ratings_with_key(spark, sf_dir):
    key = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), F.col("lang").alias("style"), F.col("source").alias("run"))
    return rated(spark, sf_dir).where(gates.complete_rating("emotion", "naturalness")).select("label", "emotion").join(key, "label")


@query(
    "o4_15_ratings_key_scores",
    f"WITH {RATED}, {CLIPS} SELECT r.label, r.emotion, CASE WHEN c.speaker = 'src0' THEN 'real recordings' ELSE c.speaker END AS run, c.f0_median_hz FROM rated r JOIN clips c ON c.doc_id = r.label WHERE r.emotion <> ''",
)
def o4_15_ratings_key_scores(spark, sf_dir):
    key = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), F.when(F.col("source") == "src0", "real recordings").otherwise(F.col("source")).alias("run"))
    scores = clips(spark, sf_dir).select(F.col("doc_id").alias("label"), "f0_median_hz")
    return rated(spark, sf_dir).where("emotion <> ''").select("label", "emotion").join(key, "label").join(scores, "label")


PAIRS = (
    f"{RUNS}, pairs AS (SELECT run, conv_id, turn // 2 AS seed, min(CASE WHEN style = 'user' THEN duration_s END) AS base, min(CASE WHEN style = 'assistant' THEN duration_s END) AS value FROM runs WHERE style IN ('user', 'assistant') GROUP BY ALL), "
    "joint AS (SELECT * FROM pairs WHERE base IS NOT NULL AND value IS NOT NULL)"
)


def pair_rows(spark, sf_dir):
    return runs(spark, sf_dir).withColumn("seed", F.expr("turn div 2"))


@query("o4_16_pairs", f"WITH {PAIRS} SELECT run, conv_id, seed, value, base FROM joint")
def o4_16_pairs(spark, sf_dir):
    return relations.paired(pair_rows(spark, sf_dir), ["run", "conv_id", "seed"], "assistant", "user", "duration_s")


@query("o4_17_two_datasets", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def o4_17_two_datasets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels(spark, sf_dir).select("doc_id", "quality"), "doc_id")


@query(
    "o4_18_split_files_agree",
    "SELECT coalesce(a.split, b.split) AS split, cast(count(*) FILTER (WHERE a.doc_id IS NULL OR b.doc_id IS NULL) AS bigint) AS differing FROM "
    "(SELECT doc_id, doc_id % 3 AS split FROM documents) a FULL JOIN (SELECT doc_id, doc_id % 3 AS split FROM labels) b ON a.doc_id = b.doc_id AND a.split = b.split GROUP BY 1",
)
def o4_18_split_files_agree(spark, sf_dir):
    a, b = (df.select("doc_id", (F.col("doc_id") % 3).alias("split")) for df in (table(spark, sf_dir, "documents"), labels(spark, sf_dir)))
    return relations.differing_ids(a, b, "doc_id")


SEGMENTS = "SELECT event_id, user_id, value AS start, value + event_id % 4 AS stop FROM events"
OVERLAPS = f"SELECT user_id, event_id, next_id FROM (SELECT *, lead(event_id) OVER w AS next_id, lead(start) OVER w AS next_start FROM ({SEGMENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id)) WHERE stop > next_start"


def segments(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "value AS start", "value + event_id % 4 AS stop")


@query("o4_19_overlapping_segments", OVERLAPS)
def o4_19_overlapping_segments(spark, sf_dir):
    return relations.overlapping_neighbours(segments(spark, sf_dir), "user_id", "start", "stop", "event_id")


@query("o6_6_adjacent_overlaps", f"SELECT user_id, cast(count(*) AS bigint) AS overlaps FROM ({OVERLAPS}) GROUP BY user_id")
def o6_6_adjacent_overlaps(spark, sf_dir):
    found = relations.overlapping_neighbours(segments(spark, sf_dir), "user_id", "start", "stop", "event_id")
    return found.groupBy("user_id").agg(F.count("*").alias("overlaps"))


@query(
    "o6_1_first_per_hash",
    "SELECT doc_id, CASE WHEN f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents WHERE n_chars >= 60)",
)
def o6_1_first_per_hash(spark, sf_dir):
    passed = table(spark, sf_dir, "documents").where("n_chars >= 60").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return relations.mark_duplicates(passed, "sha256", "doc_id").select("doc_id", "duplicate_of")


@query("o6_2_first_example", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY {norm('text')}, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def o6_2_first_example(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", normalize_transcript(F.col("text")).alias("norm"))
    return relations.first_of(rows, ["norm", "lang"], ["doc_id"]).select("doc_id", "lang")


@query(
    "o6_3_robust_z",
    f"WITH {CLIPS}, m AS (SELECT *, length(text) / duration_s AS r, median(length(text) / duration_s) OVER (PARTITION BY style) AS med FROM clips), "
    "d AS (SELECT *, median(abs(r - med)) OVER (PARTITION BY style) AS mad FROM m) SELECT doc_id, round(0.6745e0 * (r - med) / (CASE WHEN mad = 0 THEN 1e-9 ELSE mad END), 6) AS z FROM d",
)
def o6_3_robust_z(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("r", F.length("text") / F.col("duration_s"))
    return robust_z(rows.select("doc_id", "style", "r"), ["style"], "r").select("doc_id", F.round("z", 6).alias("z"))


TRIES = "tries AS (SELECT user_id, event_id AS attempt, cast(event_id % 3 AS int) AS severity, cast(event_id % 2 AS string) AS heard FROM events)"


@query(
    "o6_7_best_attempt",
    f"WITH {TRIES}, s AS (SELECT *, CASE WHEN severity = 0 OR (severity = 1 AND lag(severity) OVER w = 1 AND heard = lag(heard) OVER w) THEN 1 ELSE 0 END AS stop FROM tries WINDOW w AS (PARTITION BY user_id ORDER BY attempt)), "
    "m AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY user_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) "
    "SELECT user_id, arg_min(attempt, severity * 1000000000 + attempt) AS attempt, min(severity) AS severity, cast(count(*) AS bigint) AS tries FROM m WHERE before = 0 GROUP BY user_id",
)
def o6_7_best_attempt(spark, sf_dir):
    tries = table(spark, sf_dir, "events").selectExpr("user_id", "event_id AS attempt", "cast(event_id % 3 AS int) AS severity", "cast(event_id % 2 AS string) AS heard")
    return evaluation.best_attempt(tries, ["user_id"])


@query("o7_1_total_order", "SELECT doc_id, cast(row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS int) AS place FROM documents")
def o7_1_total_order(spark, sf_dir):
    from loomline.functions.stats import places

    return places(table(spark, sf_dir, "documents"), ["lang"], ["n_chars", "doc_id"]).select("doc_id", F.col("place").cast("int").alias("place"))


@query("o7_2_reference_last", "SELECT source AS run, cast(row_number() OVER (ORDER BY source = 'src0', source) AS int) AS place FROM (SELECT DISTINCT source FROM documents)")
def o7_2_reference_last(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "documents").select(F.col("source").alias("run")).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(*relations.reference_last("run", "src0"))))


@query("o7_3_limited_work", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 17")
def o7_3_limited_work(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(17)


def sample_sql(strata: str, k: int, seed: str, where: str = "true") -> str:
    parts = ", ".join(f"cast({s} AS string)" for s in strata.split(", "))
    return f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {strata} ORDER BY md5(concat_ws('|', '{seed}', {parts}, cast(doc_id AS string))), doc_id) AS n FROM documents WHERE {where}) WHERE n <= {k}"


@query("o7_4_stratified_sample", sample_sql("source, lang", 5, "1234"))
def o7_4_stratified_sample(spark, sf_dir):
    return relations.stratified_sample(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", 5, "1234").select("doc_id")


SUBSTYLE = next(c for c in CLIP if c.endswith(" AS substyle")).removesuffix(" AS substyle")


@query("o7_5_other_speakers", sample_sql("source, lang", 15, "other", f"source <> 'src0' AND ({SUBSTYLE}) IS NULL"))
def o7_5_other_speakers(spark, sf_dir):
    others = clips(spark, sf_dir).where("speaker <> 'src0' and substyle is null").withColumnsRenamed({"speaker": "source", "style": "lang"})
    return relations.stratified_sample(others, ["source", "lang"], "doc_id", 15, "other").select("doc_id")


@query(
    "o7_6_sentences_in_all_styles",
    "SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws('|', 'eval', cast(user_id AS string))), user_id) AS n FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5)) WHERE n <= 8",
)
def o7_6_sentences_in_all_styles(spark, sf_dir):
    everywhere = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("styles")).where("styles = 5")
    return everywhere.select("user_id").orderBy(relations.hash_order("eval", "user_id"), "user_id").limit(8)


@query("o7_7_listening_pack", sample_sql("lang", 6, "pack", "n_chars BETWEEN 200 AND 600"))
def o7_7_listening_pack(spark, sf_dir):
    return relations.stratified_sample(table(spark, sf_dir, "documents").where("n_chars between 200 and 600"), ["lang"], "doc_id", 6, "pack").select("doc_id")


@query(
    "o7_8_opaque_labels",
    "SELECT doc_id, 'c' || CASE WHEN count(*) OVER (PARTITION BY substr(h, 1, 7)) > 1 THEN h ELSE substr(h, 1, 7) END AS label FROM (SELECT doc_id, sha256('secret|' || doc_id) AS h FROM documents)",
)
def o7_8_opaque_labels(spark, sf_dir):
    return relations.shuffled_labels(table(spark, sf_dir, "documents"), "doc_id", "secret").select("doc_id", "label")


@query(
    "o7_9_group_order",
    "SELECT source, cast(row_number() OVER (ORDER BY size DESC, md5('1234|' || source)) AS int) AS place FROM (SELECT source, count(*) AS size FROM documents GROUP BY source)",
)
def o7_9_group_order(spark, sf_dir):
    from pyspark.sql import Window

    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return sizes.select("source", F.row_number().over(Window.orderBy(F.col("size").desc(), relations.hash_order("1234", "source"))).alias("place"))


@query("o7_10_coin_flips", "SELECT doc_id, CASE WHEN ('0x' || substr(md5('coin|' || doc_id), 1, 1))::int % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM documents")
def o7_10_coin_flips(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", relations.coin("coin", "doc_id").alias("side"))


@query("o7_11_examples", "SELECT lang, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY lang")
def o7_11_examples(spark, sf_dir):
    few = table(spark, sf_dir, "documents").select("lang", "doc_id")
    from pyspark.sql import Window

    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 3")
    return few.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("ids"))


@query("o8_1_rows_lost", "SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def o8_1_rows_lost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return relations.added_only(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 2 = 0"))


@query("o8_2_union_of_examples", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, source FROM documents WHERE lang <> 'en' AND doc_id % 2 = 0")
def o8_2_union_of_examples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.where("lang = 'en'").unionByName(docs.where("lang <> 'en' and doc_id % 2 = 0"))


@query("o8_3_union_with_recordings", "SELECT run, style, text, cast(seed AS bigint) AS seed FROM (SELECT 'run' AS run, role AS style, text, turn AS seed FROM conversations UNION ALL SELECT 'real recordings', lang, text, NULL FROM documents)")
def o8_3_union_with_recordings(spark, sf_dir):
    made = table(spark, sf_dir, "conversations").select(F.lit("run").alias("run"), F.col("role").alias("style"), "text", F.col("turn").alias("seed"))
    real = table(spark, sf_dir, "documents").select(F.lit("real recordings").alias("run"), F.col("lang").alias("style"), "text")
    return made.unionByName(real, allowMissingColumns=True)


@query(
    "o8_4_style_sets",
    "SELECT source, cast(len(list_distinct(list(lang))) AS int) AS styles, bool_or(lang = 'en') AND bool_or(lang = 'de') AS has_both, cast(count(DISTINCT CASE WHEN lang NOT IN ('en', 'de') THEN lang END) AS int) AS added FROM documents GROUP BY source",
)
def o8_4_style_sets(spark, sf_dir):
    sets = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("s"))
    want = F.array(F.lit("en"), F.lit("de"))
    return sets.select("source", F.size("s").alias("styles"), (F.size(F.array_intersect("s", want)) == 2).alias("has_both"), F.size(F.array_except("s", want)).alias("added"))


@query(
    "o8_5_leaks",
    f"WITH s AS (SELECT doc_id, cast(doc_id % 3 AS string) AS split, {norm('text')} AS norm, sha256(text) AS sha FROM documents) "
    "SELECT 'norm' AS key, norm AS value, 2 AS least_splits FROM s GROUP BY norm HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'sha', sha, 2 FROM s GROUP BY sha HAVING count(DISTINCT split) > 1",
)
def o8_5_leaks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 3).cast("string").alias("split"), normalize_transcript(F.col("text")).alias("norm"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    )
    return relations.leaks(rows, ["norm", "sha"])


@query("o8_6_foreign_descriptions", "SELECT DISTINCT lang || source AS description FROM documents WHERE lang || source NOT IN (SELECT lang || source FROM documents WHERE doc_id % 50 = 0)")
def o8_6_foreign_descriptions(spark, sf_dir):
    said = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", "source").alias("description"))
    return relations.only_left(said.select("description").distinct(), said.where("doc_id % 50 = 0").select("description"), ["description"])
