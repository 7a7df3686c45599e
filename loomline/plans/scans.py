"""Queries for sources, sinks and logs: the scans' parsing applied to lines and paths made from the tables."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from loomline.operators import gates, relations
from loomline.operators.components import cut_lineage
from loomline.plans import reports
from loomline.plans.base import CLIPS, clips, fresh_path, query, table
from loomline.sinks import files as sinks
from loomline.sinks.committed import mounted, write_files
from loomline.sinks.resume import ClipLog
from loomline.sources import archives, files
from loomline.sources.config import check_ratios, single_rate
from loomline.streaming import logs, tail

PATHS = [
    "doc_id",
    "CASE WHEN doc_id % 19 = 0 THEN concat('raw/read/', source, '/', lang, '/base/._', cast(doc_id AS string), '.wav') "
    "WHEN doc_id % 23 = 0 THEN concat('raw/read/', source, '/', cast(doc_id AS string), '.wav') "
    "WHEN doc_id % 29 = 0 THEN concat('raw/read/', source, '/xx/base/', source, '_', lang, '_', cast(doc_id AS string), '.wav') "
    "ELSE concat('raw/read/', source, '/', lang, '/base/', source, '_', lang, '_emph_', cast(doc_id AS string), '.wav') END AS path",
]
PATHS_SQL = "paths AS (SELECT " + ", ".join(PATHS) + " FROM documents), parts AS (SELECT substr(path, 10) AS file, string_split(substr(path, 10), '/') AS p FROM paths), " + (
    "kept AS (SELECT * FROM parts WHERE NOT starts_with(p[len(p)], '._') AND p[len(p)] <> '.DS_Store'), "
    "named AS (SELECT file, p, regexp_replace(p[4], '\\.wav$', '') AS stem FROM kept WHERE len(p) = 4), "
    "said AS (SELECT *, regexp_extract(stem, '^([^_]+)_([A-Za-z]+(_[A-Za-z]+)*)_([0-9]+)$', 1) AS sp, regexp_extract(stem, '^([^_]+)_([A-Za-z]+(_[A-Za-z]+)*)_([0-9]+)$', 2) AS mid FROM named)"
)


def paths(spark, sf_dir):
    return files.discovered(table(spark, sf_dir, "documents").selectExpr(*PATHS), "raw/read")


@query(
    "o1_6_discovered_clips",
    f"WITH {PATHS_SQL} SELECT file, stem, p[1] AS speaker, p[2] AS style, p[3] AS corpus, CASE WHEN position('_' IN mid) > 0 THEN substr(mid, position('_' IN mid) + 1) END AS substyle FROM said",
)
def o1_6_discovered_clips(spark, sf_dir):
    return paths(spark, sf_dir)[0]


@query(
    "o1_6_layout_problems",
    f"WITH {PATHS_SQL} SELECT file, 'unexpected depth' AS problem FROM kept WHERE len(p) <> 4 UNION ALL SELECT file, 'name disagrees with folders' FROM said WHERE NOT (sp = p[1] AND string_split(mid, '_')[1] = p[2])",
)
def o1_6_layout_problems(spark, sf_dir):
    return paths(spark, sf_dir)[1]


@query("o1_7_junk_names", "SELECT doc_id FROM documents WHERE doc_id % 19 = 0")
def o1_7_junk_names(spark, sf_dir):
    from loomline.functions.text import base_name, is_junk

    return table(spark, sf_dir, "documents").selectExpr(*PATHS).where(is_junk(base_name(F.col("path")))).select("doc_id")


LINES = [
    "doc_id + 1 AS line",
    "CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 13 = 0 THEN concat('no tab here ', lang) WHEN doc_id % 7 = 0 THEN concat(' stem_', cast(doc_id % 50 AS string), ' \t again ', lang) "
    "ELSE concat('stem_', cast(doc_id % 600 AS string), '\t ', lang, ' ', source, ' ') END AS content",
]
LINES_SQL = (
    "lines AS (SELECT " + ", ".join(LINES).replace("\t", "' || chr(9) || '") + " FROM documents), "
    "good AS (SELECT line, trim(split_part(content, chr(9), 1)) AS stem, trim(substr(content, instr(content, chr(9)) + 1)) AS text, content FROM lines WHERE trim(content) <> '' AND instr(content, chr(9)) > 0), "
    "nth AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY line) AS n FROM good)"
)


@query("o1_8_transcripts", f"WITH {LINES_SQL} SELECT stem, text FROM nth WHERE n = 1")
def o1_8_transcripts(spark, sf_dir):
    return files.transcripts(table(spark, sf_dir, "documents").selectExpr(*LINES))[0]


@query(
    "o1_8_transcript_problems",
    f"WITH {LINES_SQL} SELECT line, 'no tab separator' AS problem, substr(content, 1, 80) AS content FROM lines WHERE trim(content) <> '' AND instr(content, chr(9)) = 0 "
    "UNION ALL SELECT line, 'duplicate transcript for ' || stem, NULL FROM nth WHERE n > 1",
)
def o1_8_transcript_problems(spark, sf_dir):
    return files.transcripts(table(spark, sf_dir, "documents").selectExpr(*LINES))[1]


LISTED = [
    "doc_id AS line",
    "CASE WHEN doc_id % 9 = 0 THEN '# comment' WHEN doc_id % 10 = 0 THEN concat('a-b_', lang, '_', cast(doc_id AS string)) "
    "ELSE concat(source, '_', lang, '_', cast(doc_id % 400 AS string), '\t0.5') END AS content",
]


@query(
    "o1_9_split_list",
    "WITH lines AS (SELECT " + ", ".join(LISTED).replace("\t", "' || chr(9) || '") + " FROM documents) "
    "SELECT DISTINCT trim(split_part(content, chr(9), 1)) AS stem FROM lines WHERE content NOT LIKE '#%' AND split_part(trim(split_part(content, chr(9), 1)), '_', 1) NOT LIKE '%-%'",
)
def o1_9_split_list(spark, sf_dir):
    return files.split_list(table(spark, sf_dir, "documents").selectExpr(*LISTED))


@query("o1_10_jsonl_events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def o1_10_jsonl_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


EVALS = ["event_id AS line", "concat('Eval results for step (', cast(event_id % 37 AS string), ' / 370 | Eval Loss: ', cast(4 + event_id % 53 AS string), '.5, more)') AS content"]
EVALS_SQL = "evals AS (SELECT event_id AS line, event_id % 37 AS step, 4 + event_id % 53 + 0.5e0 AS loss FROM events)"


@query("o1_14_eval_log", f"WITH {EVALS_SQL} SELECT step, loss, line FROM evals")
def o1_14_eval_log(spark, sf_dir):
    return files.eval_losses(table(spark, sf_dir, "events").selectExpr(*EVALS))


@query(
    "o6_5_best_checkpoint",
    f"WITH {EVALS_SQL}, last AS (SELECT step, arg_max(loss, line) AS loss, max(line) AS line FROM evals GROUP BY step) SELECT step, loss FROM last WHERE step % 2 = 0 ORDER BY loss, line LIMIT 1",
)
def o6_5_best_checkpoint(spark, sf_dir):
    from loomline.operators.evaluation import best_checkpoint

    weights = spark.range(0, 400, 2).withColumnRenamed("id", "step")
    return best_checkpoint(files.eval_losses(table(spark, sf_dir, "events").selectExpr(*EVALS)), weights)


@query(
    "o6_8_newest_checkpoint",
    "WITH c AS (SELECT user_id, event_id % 370 AS step FROM events) SELECT user_id, max(step) AS newest, cast(count(DISTINCT step) - 1 AS bigint) AS slimmed FROM c GROUP BY user_id",
)
def o6_8_newest_checkpoint(spark, sf_dir):
    names = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("checkpoint-"), (F.col("event_id") % 370).cast("string"), F.lit("-epoch-1")).alias("name"))
    steps = names.withColumn("step", files.checkpoint_step(F.col("name")))
    return steps.groupBy("user_id").agg(F.max("step").alias("newest"), (F.countDistinct("step") - 1).alias("slimmed"))


@query("o9_20_checkpoint_names", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 370 END AS step FROM events")
def o9_20_checkpoint_names(spark, sf_dir):
    number = (F.col("event_id") % 370).cast("string")
    name = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("best-"), number)).otherwise(F.concat(F.lit("checkpoint-"), number))
    return table(spark, sf_dir, "events").select("event_id", files.checkpoint_step(name).alias("step"))


@query(
    "o2_2_jsonl_rows",
    "SELECT doc_id, concat('{\"doc_id\":', cast(doc_id AS string), ',\"lang\":\"', lang, '\",\"source\":\"', source, '\",\"n_chars\":', cast(n_chars AS string), '}') AS line FROM documents",
)
def o2_2_jsonl_rows(spark, sf_dir):
    path = fresh_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), path, ["doc_id"])
    return spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id"), F.col("value").alias("line"))


@query("o2_4_append_without_done", f"WITH {CLIPS} SELECT stem, cast(1 AS bigint) AS times, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'first' ELSE 'second' END AS run FROM clips")
def o2_4_append_without_done(spark, sf_dir):
    """A run that stopped after the labelled clips, resumed over all of them: the log has each clip once."""
    path, rows = fresh_path(spark, "log"), clips(spark, sf_dir)
    done = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    sinks.append_new(done.select("stem", F.lit("first").alias("run")), path, "stem")
    sinks.append_new(rows.select("stem", F.lit("second").alias("run")), path, "stem")
    return spark.read.schema("stem string, run string").json(path).groupBy("stem").agg(F.count("*").alias("times"), F.min("run").alias("run"))


RESUMED = (
    f"WITH {CLIPS}, made AS (SELECT doc_id, quality FROM labels) SELECT stem, CASE WHEN doc_id IN (SELECT doc_id FROM made) AND doc_id NOT IN (SELECT doc_id FROM made WHERE quality = 0) THEN 0 ELSE 1 END AS batch FROM clips"
)


@query("o2_4_resume_by_files", RESUMED)
def o2_4_resume_by_files(spark, sf_dir):
    """A log of labelled clips some of whose files (those of quality 0) never came: the run that resumes makes those again and all
    others for the first time, and a batch that is replayed adds nothing."""
    folder = fresh_path(spark, "resumed")
    log = ClipLog(spark, f"{folder}/log", f"{folder}/files", "stem string, file string, doc_id bigint", key="stem")
    rows = clips(spark, sf_dir).select("stem", F.concat("stem", F.lit(".txt")).alias("file"), "doc_id")
    made = rows.join(table(spark, sf_dir, "labels"), "doc_id")
    write_files(made.where("quality <> 0").select(F.col("file").alias("name"), F.col("stem").cast("binary").alias("content")), f"{folder}/files")
    for work, batch in ((made.select(*rows.columns), 0), (rows, 1), (rows, 1)):
        log.append(work, batch)
    return log.rows().select("stem", F.col("batch").cast("int").alias("batch"))


@query("o2_6_committed_files", "SELECT lang || '/' || doc_id || '.txt' AS name, cast(octet_length(encode(text)) AS bigint) AS bytes, sha256(text) AS sha256 FROM documents JOIN labels USING (doc_id)")
def o2_6_committed_files(spark, sf_dir):
    """Labelled documents as files, and what the folder holds then."""
    folder = fresh_path(spark, "files")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    write_files(rows.select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), folder)
    found = files.binary_files(spark, folder, "*")
    name = F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))
    return found.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: Documents in one archive of the query, and bytes of its stretches.
PACKED, STRETCH = 100, 1 << 16


def packed_documents(spark, sf_dir):
    """Tar archives of PACKED documents each, in the shared folder; returns their paths."""
    folder = fresh_path(spark, "archives")
    rows = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), "text", F.expr(f"doc_id div {PACKED}").alias("block"))

    def pack(group):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, text in zip(group.column("name").to_pylist(), group.column("text").to_pylist()):
                info = tarfile.TarInfo(name)
                info.size = len(text.encode())
                tar.addfile(info, io.BytesIO(text.encode()))
        return pa.table({"name": [f"{group.column('block')[0]}.tar"], "content": pa.array([out.getvalue()], pa.binary())})

    write_files(rows.groupBy("block").applyInArrow(pack, "name string, content binary"), folder)
    return [str(mounted(r[0])) for r in files.listed_files(spark, folder, "*.tar").select("path").collect()]  # an archive a row


TAR = "SELECT doc_id // 100 || '.tar' AS archive, lang || '/' || doc_id || '.txt' AS name, cast(octet_length(encode(text)) AS bigint) AS size, sha256(text) AS sha256 FROM documents WHERE lang <> 'fr'"


@query("o1_5_tar_members", TAR)
def o1_5_tar_members(spark, sf_dir):
    """The members of archives by their index, stretch by stretch; one language is left where it is."""
    index = cut_lineage(archives.tar_index(spark, packed_documents(spark, sf_dir), ["en/*", "de/*", "es/*"]), "tar-index")
    found = archives.tar_contents(index, STRETCH)
    return found.select(F.substring_index("archive", "/", -1).alias("archive"), "name", "size", F.sha2("content", 256).alias("sha256"))


@query("o1_5_tar_source", TAR)
def o1_5_tar_source(spark, sf_dir):
    """The same through the data source, whose partitions are stretches or, of many archives, several."""
    spark.dataSource.register(archives.TarSource)
    found = spark.read.format("loomline_tar").option("patterns", "en/*,de/*,es/*").option("run_bytes", STRETCH).load(",".join(packed_documents(spark, sf_dir)))
    return found.select(F.substring_index("archive", "/", -1).alias("archive"), "name", "size", F.sha2("content", 256).alias("sha256"))


@query("o12_followed_log", "SELECT event_id, event_type FROM events")
def o12_followed_log(spark, sf_dir):
    """Events logged as JSON lines in two goes, followed by a stream that ends and starts again in between: each line once."""
    folder = fresh_path(spark, "followed")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    spark.dataSource.register(tail.TailSource)
    for early in (True, False):
        rows.where((F.col("event_type") < "m") == early).write.mode("append").json(f"{folder}/log")
        lines = spark.readStream.format("loomline_tail").load(f"{mounted(folder)}/log/*.json")
        logs.follow(lines, f"{folder}/table", f"{folder}/state").awaitTermination()
    line = F.from_json("line", "event_id bigint, event_type string")
    return spark.read.parquet(f"{folder}/table").select(line.alias("r")).select("r.*")


@query(
    "o2_8_provenance",
    "SELECT 'labelled documents' AS source, lang || '/' || doc_id || '.txt' AS file, cast(octet_length(encode(text)) AS bigint) AS bytes, sha256(text) AS sha256, md5(text) AS md5 FROM documents JOIN labels USING (doc_id)",
)
def o2_8_provenance(spark, sf_dir):
    """What a folder of retrieved files holds, file by file."""
    folder = fresh_path(spark, "retrieved")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    write_files(rows.select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), folder)
    return sinks.provenance_rows(files.binary_files(spark, folder, "*"), str(mounted(folder)), "labelled documents").drop("retrieved_at")


FROZEN = "SELECT doc_id FROM documents WHERE doc_id % 10 = 3"
DIFFERENT = f"EXISTS ({FROZEN} EXCEPT ALL SELECT doc_id FROM labels) OR EXISTS (SELECT doc_id FROM labels EXCEPT ALL {FROZEN})"


@query("o2_10_frozen_difference", f"SELECT 'same ids' AS rerun, false AS refused UNION ALL SELECT 'other ids', {DIFFERENT} UNION ALL SELECT 'new freeze', false")
def o2_10_frozen_difference(spark, sf_dir):
    """Whether a re-run with the same ids, with others, and with others and a new freeze asked for is refused."""
    old, new = table(spark, sf_dir, "documents").where("doc_id % 10 = 3").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")

    def refused(*args) -> bool:
        try:
            relations.frozen_or_raise(*args)
        except ValueError:
            return True
        return False

    cases = [("same ids", refused(old, old)), ("other ids", refused(old, new)), ("new freeze", refused(old, new, True))]
    return spark.createDataFrame(cases, "rerun string, refused boolean")


@query(
    "o9_6_history",
    "SELECT event_id AS at, concat(event_type, '-', cast(user_id AS string)) AS file, concat('/clips/', event_type, '-', cast(user_id AS string)) AS url FROM events "
    "WHERE user_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY event_id DESC LIMIT 30",
)
def o9_6_history(spark, sf_dir):
    from loomline.streaming.logs import history

    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("file"), "user_id")
    there = log.join(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("user_id")), "user_id", "left_semi").select("file")
    return history(log.select("at", "file"), there)


@query("o1_11_json_document", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def o1_11_json_document(spark, sf_dir):
    """A nested document written as one JSON text over several lines, read again and exploded to rows."""
    path = fresh_path(spark, "document")
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    regions = table(spark, sf_dir, "region").join(nations, "r_regionkey").groupBy().agg(F.collect_list(F.struct("r_name", "nations")).alias("regions"))
    regions.select(F.to_json(F.struct("regions"), {"pretty": "true"})).write.text(path)
    doc = files.json_document(spark, path, "regions array<struct<r_name:string,nations:array<struct<n_nationkey:int,n_name:string>>>>")
    each = doc.select(F.explode("regions").alias("r")).select("r.r_name", F.explode("r.nations").alias("n"))
    return each.select("n.n_nationkey", "n.n_name", "r_name")


@query("o1_15_single_rate", "SELECT r_name, cast(16000 * (1 + r_regionkey) AS int) AS rate, true AS agreed FROM region UNION ALL SELECT 'all', NULL, count(DISTINCT r_regionkey) = 1 FROM region")
def o1_15_single_rate(spark, sf_dir):
    """Each region's models name one rate; all of them together don't."""
    rated = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = rated.groupBy("r_name").agg(F.collect_set(16000 * (1 + F.col("n_regionkey"))).alias("rates")).collect()  # five regions

    def agreed(rates: list[int]) -> tuple[int | None, bool]:
        try:
            return single_rate(rates), True
        except ValueError:
            return None, False

    cases = [(r["r_name"], *agreed(r["rates"])) for r in named] + [("all", *agreed([x for r in named for x in r["rates"]]))]
    return spark.createDataFrame(cases, "r_name string, rate int, agreed boolean")


@query(
    "o3_12_checkpoints_with_weights",
    f"WITH {EVALS_SQL}, last AS (SELECT step, arg_max(loss, line) AS loss FROM evals GROUP BY step) SELECT step, loss FROM last WHERE step IN (SELECT event_id % 370 FROM events WHERE event_type = 'purchase')",
)
def o3_12_checkpoints_with_weights(spark, sf_dir):
    losses = files.eval_losses(table(spark, sf_dir, "events").selectExpr(*EVALS))
    last = losses.groupBy("step").agg(F.max_by("loss", "line").alias("loss"))
    names = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.concat(F.lit("checkpoint-"), (F.col("event_id") % 370).cast("string"), F.lit("-epoch-1")).alias("name"))
    return last.join(names.select(files.checkpoint_step(F.col("name")).alias("step")).distinct(), "step", "left_semi")


RULES = {"language known": "lang IS NOT NULL", "at least 60 characters": "n_chars >= 60", "length as counted": "length(text) = n_chars", "labelled": "quality IS NOT NULL", "good": "quality = 1", "not toxic": "toxic = 0"}
JUDGED = "j AS (SELECT documents.*, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(
    "o3_13_assertions",
    f"WITH {JUDGED} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, cast(count(*) FILTER (WHERE ({c}) IS NOT TRUE) AS bigint) AS rows FROM j" for n, c in RULES.items())
    + " UNION ALL SELECT 'passed what is required', count(*) FILTER (WHERE lang IS NOT NULL) FROM j",
)
def o3_13_assertions(spark, sf_dir):
    """How many rows break each rule; then those rules that must hold, which end the query if they don't: shares of the languages, and a known language."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    found = gates.violations(rows, {n: F.expr(c) for n, c in RULES.items()})
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    check_ratios({k: n / sum(counts.values()) for k, n in counts.items()})
    passed = gates.require(rows, {"language known": F.col("lang").isNotNull()}).agg(F.count("*").alias("rows")).select(F.lit("passed what is required").alias("rule"), "rows")
    return found.unionByName(passed)


@query(
    "o2_3_summary_report",
    "WITH t AS (SELECT lang, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY lang) SELECT cast(0 AS int) AS nth, '| lang | n | mean |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL "
    "SELECT 1 + cast(row_number() OVER (ORDER BY lang) AS int), '| ' || lang || ' | ' || n || ' | ' || format('{:.1f}', mean) || ' |' FROM t",
)
def o2_3_summary_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")).orderBy("lang").collect()  # a row a language
    lines = sinks.markdown_table(["lang", "n", "mean"], rows, {"mean": ".1f"}).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "nth int, line string")


THIRDS = "CASE doc_id % 3 WHEN 0 THEN 'test' ELSE 'train' END"


@query(
    "o2_3_split_report",
    f"WITH e AS (SELECT {THIRDS} AS split, lang AS style, n_chars AS s FROM documents), g AS (SELECT split, style, 0 AS whole, count(*) AS n, sum(s) AS s FROM e GROUP BY split, style UNION ALL SELECT split, 'total', 1, count(*), sum(s) FROM e GROUP BY split) "
    "SELECT cast(row_number() OVER (ORDER BY split, whole, style) - 1 AS int) AS nth, '| ' || split || ' | ' || style || ' | ' || n || ' | ' || cast(s // 3600 AS bigint) || ':' || lpad(cast(cast(s % 3600 // 60 AS bigint) AS string), 2, '0') || ':' || lpad(cast(cast(s % 60 AS bigint) AS string), 2, '0') || ' |' AS line FROM g",
)
def o2_3_split_report(spark, sf_dir):
    """The rows of a split report: clips and time per split and language, with totals."""
    rows = table(spark, sf_dir, "documents").selectExpr(f"{THIRDS} AS split", "lang AS style", "cast(n_chars AS double) AS duration_s")
    found = reports.split_table(rows).collect()  # a row a split and language
    lines = sinks.markdown_table(["split", "style", "clips", "time"], found).splitlines()[2:]
    return spark.createDataFrame(list(enumerate(lines)), "nth int, line string")
