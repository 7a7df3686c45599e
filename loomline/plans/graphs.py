"""Queries for components, splits, extension, selection, audio, caches and the classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomline.functions.pieces import by_pieces
from loomline.functions.text import normalize_transcript
from loomline.operators import audio, evaluation, gates, relations, scoring, splits
from loomline.operators.components import connected_components, cut_lineage
from loomline.operators.incremental import GroupStore
from loomline.plans import workflows
from loomline.plans.aggregates import CLAIMS, RANKS, claims, gated
from loomline.plans.base import fresh_path, norm, query, table
from loomline.sinks.committed import write_files
from loomline.sources.files import binary_files, listed_files

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
EXAMPLES = f"ex AS (SELECT doc_id AS id, lang AS style, {norm('text')} AS norm, sha256(text) AS sha, CASE WHEN doc_id % 10 = 0 THEN 's' || (doc_id // 40) ELSE 'f' || doc_id END AS file FROM documents)"
COMPONENTS = (
    f"{EXAMPLES}, keys AS (SELECT id, 'n' || norm AS k FROM ex UNION ALL SELECT id, 's' || sha FROM ex UNION ALL SELECT id, file FROM ex), "
    "edges AS (SELECT DISTINCT a.id AS a, m.m AS b FROM keys a JOIN (SELECT k, min(id) AS m FROM keys GROUP BY k) m USING (k)), links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), "
    "reach AS (SELECT id AS a, id AS b FROM ex UNION SELECT r.a, e.b FROM reach r JOIN links e ON e.a = r.b), comp AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)"
)
KEYS = ["norm", "sha", "file"]


def greedy(n: str, members: str, start: str = "SELECT NULL AS split, NULL AS style, 0 AS n WHERE false") -> str:
    """The greedy placement, a group a step, as CTEs that end in placed{n} (group_id, split): counts per split and style are lists
    in the styles' order. members: a table (id, group_id, style); start: a query (split, style, n) of what is held."""
    lack = ", ".join(f"list_sum(list_transform(total, lambda t, j: ({r} * t - {x}[j]) / greatest({r} * t, 1e-9) * brings[j])) AS l{x}" for x, r in (("a", "0.8e0"), ("b", "0.1e0"), ("c", "0.1e0")))
    own = ", ".join(f"list(coalesce({x}, 0)::DOUBLE ORDER BY k) AS {x}" for x in "abc")
    sides = ", ".join(f"sum(n) FILTER (split = '{s}') AS {x}" for x, s in zip("abc", ("train", "validation", "test")))
    return (
        f"held{n} AS ({start}), styles{n} AS (SELECT style, row_number() OVER (ORDER BY style) AS k, sum(n) AS n FROM (SELECT style, count(*) AS n FROM {members} GROUP BY style UNION ALL SELECT style, n FROM held{n}) GROUP BY style), "
        f"totals{n} AS (SELECT list(n ORDER BY k) AS total, {own} FROM styles{n} LEFT JOIN (SELECT style, {sides} FROM held{n} GROUP BY style) USING (style)), "
        f"cells{n} AS (SELECT group_id, s.k, s.style, count(m.style) AS n FROM (SELECT DISTINCT group_id FROM {members}) CROSS JOIN styles{n} s LEFT JOIN {members} m USING (group_id, style) GROUP BY group_id, s.k, s.style), "
        f"shapes{n} AS (SELECT group_id, sum(n) AS size, list(n ORDER BY k) AS brings, '[' || string_agg('{{\"style\":\"' || style || '\",\"n\":' || n || '}}', ',' ORDER BY k) FILTER (n > 0) || ']' AS shape FROM cells{n} GROUP BY group_id), "
        f"queue{n} AS (SELECT *, row_number() OVER (ORDER BY size DESC, md5('1234|' || shape), shape, md5('1234|' || group_id), group_id) AS i FROM shapes{n}), "
        f"fold{n} AS (SELECT cast(0 AS bigint) AS i, '' AS group_id, '' AS split, a, b, c FROM totals{n} UNION ALL "
        "SELECT i, group_id, split, CASE WHEN split = 'train' THEN list_transform(a, lambda x, j: x + brings[j]) ELSE a END, CASE WHEN split = 'validation' THEN list_transform(b, lambda x, j: x + brings[j]) ELSE b END, "
        "CASE WHEN split = 'test' THEN list_transform(c, lambda x, j: x + brings[j]) ELSE c END FROM (SELECT *, CASE WHEN la >= lb AND la >= lc THEN 'train' WHEN lb >= lc THEN 'validation' ELSE 'test' END AS split FROM ("
        f"SELECT q.i, q.group_id, q.brings, f.a, f.b, f.c, {lack} FROM fold{n} f JOIN queue{n} q ON q.i = f.i + 1 CROSS JOIN (SELECT total FROM totals{n})))), "
        f"placed{n} AS (SELECT group_id, split FROM fold{n} WHERE i > 0)"
    )


MEMBERS = "members AS (SELECT id, 'g_' || root AS group_id, style FROM comp JOIN ex USING (id))"
PLACED = f"{COMPONENTS}, {MEMBERS}, {greedy('', 'members')}, rows AS (SELECT * FROM members JOIN placed USING (group_id))"


def examples(spark, sf_dir):
    file = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("s"), F.expr("cast(doc_id div 40 AS string)"))).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("style"), normalize_transcript(F.col("text")).alias("norm"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), file.alias("file"), (F.col("n_chars") / 60).alias("duration_s")
    )


def split_rows(spark, sf_dir, where: str = "true"):
    rows = examples(spark, sf_dir).where(where)
    rows = rows.join(splits.group_examples(rows, "id", KEYS), "id")
    return rows.join(splits.place_groups(rows, RATIOS, 1234), "group_id")


@query("o10_1_components", f"WITH RECURSIVE {COMPONENTS} SELECT id, 'g_' || root AS group_id FROM comp")
def o10_1_components(spark, sf_dir):
    return splits.group_examples(examples(spark, sf_dir), "id", KEYS)


@query("o10_1_incremental_components", f"WITH RECURSIVE {COMPONENTS} SELECT id, 'g_' || root AS group_id FROM comp")
def o10_1_incremental_components(spark, sf_dir):
    """Components of a table that came in three parts, language by language: those of the whole table."""
    store = GroupStore(spark, fresh_path(spark, "groups"), "id", KEYS)
    for part in ("style IN ('en', 'de') OR style IS NULL", "style = 'es'", "style NOT IN ('en', 'de', 'es')"):
        store.extend(examples(spark, sf_dir).where(part))
    return store.labels()


@query(
    "o10_1_edge_components",
    "WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_custkey * 100 + 7 AS b FROM orders), links AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON e.a = r.b) SELECT a AS node, min(b) AS component FROM reach GROUP BY a",
)
def o10_1_edge_components(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS a", "o_custkey * 100 + 7 AS b")
    return connected_components(edges)


@query("o10_2_place_groups", f"WITH RECURSIVE {PLACED} SELECT id, group_id, split FROM rows")
def o10_2_place_groups(spark, sf_dir):
    return split_rows(spark, sf_dir).select("id", "group_id", "split")


@query(
    "o10_3_split_violations",
    f"WITH RECURSIVE {PLACED}, want(split, ratio) AS (VALUES ('train', 0.8e0), ('validation', 0.1e0), ('test', 0.1e0)), grid AS (SELECT style, s.n AS whole, split, ratio, count(r.id) AS n FROM styles s CROSS JOIN want LEFT JOIN rows r USING (style, split) GROUP BY ALL) "
    "SELECT 'share of split' AS \"check\", split AS detail FROM want LEFT JOIN rows USING (split) GROUP BY split, ratio HAVING count(id) > 0 AND abs(count(id) / (SELECT count(*) FROM rows) - ratio) > 0.02e0 "
    "UNION ALL SELECT 'style missing in split', split || '/' || style FROM grid WHERE n = 0 UNION ALL SELECT 'share of style', split || '/' || style FROM grid WHERE abs(n / whole - ratio) > 0.04e0 "
    "UNION ALL SELECT 'key in two splits', k FROM (SELECT k FROM keys JOIN rows USING (id) GROUP BY k HAVING count(DISTINCT split) > 1)",
)
def o10_3_split_violations(spark, sf_dir):
    return splits.verify_splits(split_rows(spark, sf_dir), RATIOS, [*KEYS, "group_id"])


SPOKEN = "doc_id AS id, lang AS style, 's' || (doc_id // 40) AS file, doc_id AS start, doc_id + 1 + doc_id % 3 AS stop, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split"


@query(
    "o10_3_torn_segments",
    f"WITH s AS (SELECT {SPOKEN} FROM documents), n AS (SELECT *, lead(id) OVER w AS next_id, lead(start) OVER w AS next_start, lead(split) OVER w AS next_split FROM s WINDOW w AS (PARTITION BY file ORDER BY start, id)) "
    "SELECT 'overlapping segments in two splits' AS \"check\", id || '/' || next_id AS detail FROM n WHERE stop > next_start AND split <> next_split "
    "UNION ALL SELECT 'prepared file missing', cast(id AS string) FROM s WHERE id NOT IN (SELECT doc_id FROM labels)",
)
def o10_3_torn_segments(spark, sf_dir):
    """Segments of one recording that overlap across splits, and rows whose prepared file (a labelled document) is missing."""
    rows = table(spark, sf_dir, "documents").selectExpr(*[c.replace("doc_id // 40", "doc_id div 40") for c in SPOKEN.split(", ")])
    there = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))
    found = splits.verify_splits(rows.withColumn("path", F.col("id")), RATIOS, ["file"], segments=("file", "start", "stop"), prepared=there, path="path")
    return found.where(F.col("check").isin("overlapping segments in two splits", "prepared file missing"))


@query("o10_3_balance", f"WITH RECURSIVE {PLACED} SELECT split, cast(count(*) AS bigint) AS n, abs(count(*) / (SELECT count(*) FROM rows) - CASE split WHEN 'train' THEN 0.8e0 ELSE 0.1e0 END) <= 0.02e0 AS within FROM rows GROUP BY split")
def o10_3_balance(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in RATIOS.items() for x in kv]), F.col("split"))
    total = rows.agg(F.count("*").alias("all"))
    shares = rows.groupBy("split").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return shares.select("split", "n", (F.abs(F.col("n") / F.col("all") - wanted) <= splits.SHARE_TOLERANCE).alias("within"))


BLIND = (
    "SELECT 'c' || CASE WHEN count(*) OVER (PARTITION BY substr(h, 1, 7)) > 1 THEN h ELSE substr(h, 1, 7) END AS label, doc_id, source AS run "
    "FROM (SELECT sha256('page|' || doc_id) AS h, doc_id, source FROM documents)"
)


@query("o10_4_blinded_trials", f"SELECT label, n_chars FROM ({BLIND}) JOIN documents USING (doc_id)")
def o10_4_blinded_trials(spark, sf_dir):
    return relations.blinded(table(spark, sf_dir, "documents"), "doc_id", "page", ["n_chars"])[0]


@query("o10_4_blinding_key", BLIND)
def o10_4_blinding_key(spark, sf_dir):
    key = relations.blinded(table(spark, sf_dir, "documents"), "doc_id", "page", ["n_chars"])[1]
    return key.select("label", "doc_id", F.col("source").alias("run"))


OLD_PLACED = PLACED.replace("FROM documents)", "FROM documents WHERE lang <> 'es')")
GROWN = (
    f"{OLD_PLACED}, grown AS (SELECT * FROM (WITH RECURSIVE {COMPONENTS} SELECT id, root, style FROM comp JOIN ex USING (id))), "
    "touched AS (SELECT root, min(split) AS split, min(group_id) AS group_id FROM grown JOIN rows USING (id) GROUP BY root), "
    "fresh AS (SELECT id, 'g_' || root AS group_id, style FROM grown WHERE root NOT IN (SELECT root FROM touched)), "
    + greedy("2", "fresh", "SELECT split, style, count(*) AS n FROM rows GROUP BY split, style")
)


@query(
    "o10_5_extension_invariants",
    f"WITH RECURSIVE {GROWN} SELECT g.id, coalesce(rows.group_id, touched.group_id, fresh.group_id) AS group_id, coalesce(rows.split, touched.split, placed2.split) AS split "
    "FROM grown g LEFT JOIN rows ON rows.id = g.id LEFT JOIN touched ON touched.root = g.root LEFT JOIN fresh ON fresh.id = g.id LEFT JOIN placed2 ON placed2.group_id = fresh.group_id",
)
def o10_5_extension_invariants(spark, sf_dir):
    """After an extension: old rows in the splits that they had, new rows of an old component in its split and group, all others placed.
    New rows may join old groups of two splits here (larger tables have such rows); they go to the first by name, and every row has a place."""
    old = cut_lineage(split_rows(spark, sf_dir, "style <> 'es'").select("id", "style", *KEYS, "duration_s", "group_id", "split"))
    grown = splits.extend_splits(old, examples(spark, sf_dir).where("style = 'es'"), KEYS, RATIOS, 1234, clash="least")
    return grown.select("id", "group_id", "split")


@query(
    "o10_6_extended_eval_set",
    "SELECT item_id, 'en,fr' AS styles, cast(item_id * 3 AS string) || ',' || cast(f AS string) AS refs FROM benchmark, (SELECT min(doc_id) AS f FROM documents WHERE lang = 'fr')",
)
def o10_6_extended_eval_set(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.create_map(F.lit("en"), F.col("item_id") * 3).alias("refs"))
    first = table(spark, sf_dir, "documents").where("lang = 'fr'").groupBy(F.col("lang").alias("style")).agg(F.min("doc_id").alias("ref"))
    references = items.select("item_id").crossJoin(F.broadcast(first))  # one row
    history = spark.createDataFrame([("2024-01-01", "en")], "at string, styles string")
    grown, _ = evaluation.extend_eval_set(items, references, history, "2024-06-01")
    return grown.select("item_id", F.array_join(F.sort_array(F.map_keys("refs")), ",").alias("styles"), F.concat_ws(",", F.col("refs")["en"].cast("string"), F.col("refs")["fr"].cast("string")).alias("refs"))


@query(
    "o10_7_eligible_speakers",
    f"{RANKS}, bad AS ({CLAIMS} SELECT DISTINCT speaker FROM c WHERE c.ok = 'NOT supported'), e AS (SELECT a.*, eligible AND bad.speaker IS NULL AS ok FROM a LEFT JOIN bad USING (speaker)) "
    "SELECT cast(row_number() OVER (ORDER BY ok DESC, least DESC, total DESC, speaker) AS int) AS place, speaker, ok AS eligible FROM e",
)
def o10_7_eligible_speakers(spark, sf_dir):
    good = gated(spark, sf_dir).where(gates.usable(F.col("issues")))
    return gates.speaker_ranking(good, ["en", "fr"], 20.0, claims(spark, sf_dir)).select("place", "speaker", "eligible")


ACCEPT = (
    "passed AS (SELECT doc_id, lang, n_chars, length(text) / (n_chars / 60e0 + doc_id % 3) AS r, sha256(text) AS sha FROM documents WHERE n_chars >= 60 AND doc_id % 37 <> 0 AND doc_id % 41 <> 0), "
    "first AS (SELECT *, min(doc_id) OVER (PARTITION BY sha) AS f FROM passed), u AS (SELECT * FROM first WHERE f = doc_id), "
    "m AS (SELECT *, median(r) OVER (PARTITION BY lang) AS med FROM u), d AS (SELECT *, median(abs(r - med)) OVER (PARTITION BY lang) AS mad FROM m), "
    "z AS (SELECT *, 0.6745e0 * (r - med) / CASE WHEN mad = 0 THEN 1e-9 ELSE mad END AS z FROM d)"
)


@query(
    "o10_8_accepted_and_excluded",
    f"WITH {ACCEPT} SELECT doc_id, 'too_short' AS reason FROM documents WHERE n_chars < 60 UNION ALL SELECT doc_id, 'resample_changed' FROM documents WHERE n_chars >= 60 AND (doc_id % 37 = 0 OR doc_id % 41 = 0) "
    "UNION ALL SELECT doc_id, 'duplicate_audio' FROM first WHERE f <> doc_id UNION ALL SELECT doc_id, CASE WHEN abs(z) > 6 THEN 'unusual_pace' ELSE 'accepted' END FROM z",
)
def o10_8_accepted_and_excluded(spark, sf_dir):
    short = F.array(F.struct(F.lit("too_short").alias("code"), F.lit("under 60 characters").alias("detail")))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("stem"), F.col("lang").alias("style"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), (F.col("n_chars") / 60 + F.col("doc_id") % 3).alias("duration_s"),
        F.when(F.col("n_chars") < 60, short).otherwise(F.filter(short, lambda x: F.lit(False))).alias("issues"), F.expr("CASE WHEN doc_id % 37 = 0 THEN 3 ELSE 2 END").alias("length_error"), F.expr("CASE WHEN doc_id % 41 = 0 THEN -0.2D ELSE 0.1D END").alias("level_error_db"),
    )
    accepted, excluded = workflows.accept(rows)
    return accepted.select(F.col("id").alias("doc_id"), F.lit("accepted").alias("reason")).unionByName(excluded.select(F.col("id").alias("doc_id"), F.col("reasons")[0].alias("reason")))


@query("o10_9_same_assignment_twice", f"WITH RECURSIVE {PLACED} SELECT id, split, split AS again FROM rows")
def o10_9_same_assignment_twice(spark, sf_dir):
    """Every row's split, and its split when the assignment is made again from rows in another order."""
    rows = examples(spark, sf_dir)
    rows = cut_lineage(rows.join(splits.group_examples(rows, "id", KEYS), "id").select("id", "group_id", "style"))
    once = splits.place_groups(rows, RATIOS, 1234)
    again = splits.place_groups(rows.repartition(7), RATIOS, 1234).withColumnRenamed("split", "again")
    return rows.join(once, "group_id").join(again, "group_id", "left").select("id", "split", "again")


#: Clips that a task makes and measures: ids are few bytes, so a file of them would be one task.
CLIPS_A_TASK = 500


def clip_ids(spark, sf_dir):
    """The ids that clips are made from, dealt out by the work that they make."""
    ids = table(spark, sf_dir, "labels").select("doc_id")
    return ids.repartition(ids.count() // CLIPS_A_TASK + 1)


def tone_clips(ids: list) -> list:
    """A clip made from an id: a tone of a known pitch and level after 0.1 s of near silence."""

    def one(i: int) -> bytes:
        t = np.arange(8000) / 16000
        x = 0.1 * (1 + i % 5) * np.sin(2 * np.pi * (100 + 10 * (i % 20)) * t)
        x[:1600] *= 1e-4
        return audio.wav_bytes(x, 16000, ("PCM_16", "PCM_24", "FLOAT")[i % 3])

    return [one(i) for i in ids]


tone = by_pieces(tone_clips, "binary")


def tones(spark, sf_dir):
    return clip_ids(spark, sf_dir).select("doc_id", tone("doc_id").alias("content"))


TONE = "SELECT doc_id, 'WAV' AS format, CASE doc_id % 3 WHEN 0 THEN 'PCM_16' WHEN 1 THEN 'PCM_24' ELSE 'FLOAT' END AS subtype, cast(16000 AS int) AS sample_rate, cast(1 AS int) AS channels, cast(8000 AS bigint) AS decoded_frames, 0.5e0 AS duration_s, round(0.1e0 * (1 + doc_id % 5), 2) AS peak FROM labels"


@query("o11_1_analyze_audio", TONE)
def o11_1_analyze_audio(spark, sf_dir):
    m = tones(spark, sf_dir).select("doc_id", audio.measured(F.col("content")).alias("m")).select("doc_id", "m.*")
    return m.select("doc_id", "format", "subtype", "sample_rate", "channels", "decoded_frames", "duration_s", F.round("peak", 2).alias("peak"))


def odd_clip_clips(ids: list) -> list:
    """A clip whose rate, channels, length and samples that are no numbers follow from its id; every 13th is no WAV."""

    def one(i: int) -> bytes:
        x = np.full((100 * (i % 6), 1 + i % 2), 0.25)
        x[: i % 4] = np.nan
        return b"no sound" if i % 13 == 0 else audio.wav_bytes(x, (48000, 44100)[i % 5 == 0], "FLOAT")

    return [one(i) for i in ids]


odd_clip = by_pieces(odd_clip_clips, "binary")


@query(
    "o1_12_wav_header_problems",
    "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'not WAV' ELSE array_to_string(list_filter([CASE WHEN doc_id % 6 = 0 THEN 'no frames' END, CASE WHEN doc_id % 5 = 0 THEN '44100 Hz' END, CASE WHEN doc_id % 2 = 1 THEN '2 channels' END], lambda x: x IS NOT NULL), '; ') END AS problems FROM labels",
)
def o1_12_wav_header_problems(spark, sf_dir):
    found = clip_ids(spark, sf_dir).select("doc_id", audio.header_problems(odd_clip("doc_id")).alias("p"))
    return found.select("doc_id", F.when(F.col("p").startswith("not WAV"), "not WAV").otherwise(F.col("p")).alias("problems"))


@query("o2_5_audio_files", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'PCM_16' WHEN 1 THEN 'PCM_24' ELSE 'FLOAT' END AS subtype, cast(8000 AS bigint) AS frames FROM labels")
def o2_5_audio_files(spark, sf_dir):
    """Clips written in the three codings of prepared, paged and generated audio, and read back sample by sample."""
    folder = fresh_path(spark, "audio")
    write_files(clip_ids(spark, sf_dir).select(F.concat("doc_id", F.lit(".wav")).alias("name"), tone("doc_id").alias("content")), folder)
    back = binary_files(spark, folder).select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint").alias("doc_id"), audio.measured(F.col("content")).alias("m"))
    return back.select("doc_id", "m.subtype", F.col("m.decoded_frames").alias("frames"))


@query(
    "o1_12_wav_header_ranges",
    "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'not WAV' ELSE array_to_string(list_filter([CASE WHEN doc_id % 6 = 0 THEN 'no frames' END, CASE WHEN doc_id % 5 = 0 THEN '44100 Hz' END, CASE WHEN doc_id % 2 = 1 THEN '2 channels' END], lambda x: x IS NOT NULL), '; ') END AS problems FROM labels",
)
def o1_12_wav_header_ranges(spark, sf_dir):
    """The same of files in a folder, of which only headers are read."""
    folder = fresh_path(spark, "wav")
    write_files(clip_ids(spark, sf_dir).select(F.concat("doc_id", F.lit(".wav")).alias("name"), odd_clip("doc_id").alias("content")), folder)
    found = audio.scanned_headers(listed_files(spark, folder).select("path"))
    return found.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint").alias("doc_id"), F.when(F.col("problems").startswith("not WAV"), "not WAV").otherwise(F.col("problems")).alias("problems"))


@query(
    "o1_13_wav_decode",
    "SELECT doc_id, cast(100 * (doc_id % 6) AS bigint) AS decoded_frames, cast(CASE WHEN doc_id % 6 > 0 THEN (doc_id % 4) * (1 + doc_id % 2) ELSE 0 END AS bigint) AS nonfinite_samples FROM labels WHERE doc_id % 13 <> 0",
)
def o1_13_wav_decode(spark, sf_dir):
    m = clip_ids(spark, sf_dir).where("doc_id % 13 <> 0").select("doc_id", audio.measured(odd_clip("doc_id")).alias("m"))
    return m.select("doc_id", F.coalesce("m.decoded_frames", F.lit(0)).alias("decoded_frames"), F.coalesce("m.nonfinite_samples", F.lit(0)).alias("nonfinite_samples"))


def fading_clips(ids: list) -> list:
    """A tone of 200 Hz whose last 100 ms lie lower by 6 dB times id modulo 6."""

    def one(i: int) -> bytes:
        x = 0.4 * np.sin(2 * np.pi * 200 * np.arange(16000) / 16000)
        x[-1600:] *= 10 ** (-6 * (i % 6) / 20)
        return audio.wav_bytes(x, 16000, "PCM_24")

    return [one(i) for i in ids]


fading = by_pieces(fading_clips, "binary")


@query("o11_2_end_gap", "SELECT doc_id, cast(6 * (doc_id % 6) AS bigint) AS gap_db FROM labels")
def o11_2_end_gap(spark, sf_dir):
    return clip_ids(spark, sf_dir).select("doc_id", F.round(audio.end_gap_db(fading("doc_id"))).cast("bigint").alias("gap_db"))


@query("o11_3_pitch_profile", "SELECT doc_id, 100 + 10 * (doc_id % 20) AS pitch_hz FROM labels")
def o11_3_pitch_profile(spark, sf_dir):
    p = tones(spark, sf_dir).select("doc_id", audio.pitched(F.col("content")).alias("p"))
    return p.select("doc_id", (F.round(F.col("p.f0_median_hz") / 10) * 10).cast("bigint").alias("pitch_hz"))


def half_voiced_clips(ids: list) -> list:
    """Two seconds, of which a fifth times id modulo 5 is hiss and the rest a tone."""
    whole = 0.4 * np.sin(2 * np.pi * 200 * np.arange(32000) / 16000)

    def one(i: int) -> bytes:
        x = whole.copy()
        n = 6400 * (i % 5)
        x[:n] = 0.1 * np.random.default_rng(i).standard_normal(n)
        return audio.wav_bytes(x, 16000, "PCM_16")

    return [one(i) for i in ids]


half_voiced = by_pieces(half_voiced_clips, "binary")


@query("o11_4_voicing", "SELECT doc_id, round(1 - (doc_id % 5) / 5, 1) AS voiced FROM labels")
def o11_4_voicing(spark, sf_dir):
    p = clip_ids(spark, sf_dir).select("doc_id", audio.pitched(half_voiced("doc_id")).alias("p"))
    return p.select("doc_id", F.round("p.voiced_fraction", 1).alias("voiced"))


@query("o11_5_resample", "SELECT doc_id, 'PCM_24' AS subtype, cast(24000 AS int) AS sample_rate, cast(12000 AS bigint) AS decoded_frames, round(10 * log10(pow(0.1e0 * (1 + doc_id % 5), 2) / 2 * 0.8e0), 1) AS rms_dbfs FROM labels")
def o11_5_resample(spark, sf_dir):
    r = tones(spark, sf_dir).select("doc_id", audio.resampled_wav(F.col("content"), 24000).alias("r"))
    m = r.select("doc_id", audio.measured(F.col("r.wav")).alias("m"))
    return m.select("doc_id", "m.subtype", "m.sample_rate", "m.decoded_frames", F.round("m.rms_dbfs", 1).alias("rms_dbfs"))


class LengthScorer:
    """A stand-in for a model: the number of bytes."""

    measure = "bytes"

    def load(self):
        return lambda contents: contents.map(len)


@query("o11_10_measure_cache", "SELECT sha256(text) AS sha256, cast(any_value(octet_length(encode(text))) AS string) AS value FROM documents WHERE doc_id % 4 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) GROUP BY 1")
def o11_10_measure_cache(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    cache = scoring.scored(files.where("doc_id % 4 = 0"), LengthScorer()).distinct()
    return scoring.extend_cache(files.where("doc_id % 4 <> 0"), cache, LengthScorer()).select("sha256", "value")


@query("o11_10_bucketed_cache", "SELECT doc_id, cast(octet_length(encode(text)) AS string) AS bytes FROM documents")
def o11_10_bucketed_cache(spark, sf_dir):
    """A cache that is filled with a quarter of the documents, extended by all of them, and asked for each."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    cache = scoring.MeasureCache(spark, fresh_path(spark, "measures"), 16)
    cache.extend(files.where("doc_id % 4 = 0"), LengthScorer())
    cache.extend(files, LengthScorer())
    return cache.values(files.select("doc_id", F.sha2("content", 256).alias("sha256")), "bytes").select("doc_id", "bytes")


@query("o11_8_vector_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def o11_8_vector_similarity(spark, sf_dir):
    unit = evaluation.unit_vectors(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "unit")
    later = unit.select((F.col("vec_id") - 1).alias("vec_id"), F.col("unit").alias("next"))
    return unit.join(later, "vec_id").select("vec_id", F.round(evaluation.similarity(F.col("unit"), F.col("next")), 4).alias("similarity"))


@query("o11_11_style_classifier")
def o11_11_style_classifier(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    _, found = evaluation.style_classifier(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), "embedding", "label")
    return found.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
