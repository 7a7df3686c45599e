"""The bucketed cache, header scans, rules, counters, provenance and English spellings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import english, stats
from loomline.operators import audio, gates, scoring
from loomline.plans import registry, workflows
from loomline.sinks import files as sinks
from loomline.sinks.committed import write_files
from loomline.sources.files import binary_files


class Counting:
    """Scores contents by their length and leaves a mark for each that it was asked for."""

    measure = "bytes"

    def __init__(self, marks):
        self.marks = str(marks)

    def load(self):
        import os
        from uuid import uuid4

        def run(contents):
            for _ in contents:
                open(os.path.join(self.marks, uuid4().hex), "w").close()
            return contents.map(len)

        return run


def test_bucketed_cache(spark, tmp_path):
    import os

    (tmp_path / "marks").mkdir()
    scorer = Counting(tmp_path / "marks")
    files = spark.createDataFrame([(f"p{i}", bytearray(b"x" * (i % 40))) for i in range(200)], "path string, content binary").repartition(4)
    cache = scoring.MeasureCache(spark, str(tmp_path / "cache"), 8)
    assert cache.extend(files.where("path < 'p11'"), scorer) == len({i % 40 for i in range(200) if f"p{i}" < "p11"})
    rest = cache.extend(files, scorer)
    assert cache.extend(files, scorer) == 0 and cache.rows("bytes").count() == 40 and cache.rows("other").count() == 0
    assert len(os.listdir(tmp_path / "marks")) == 40 and 0 < rest < 40
    again = scoring.MeasureCache(spark, str(tmp_path / "cache"), 8)
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    assert {r.path: r.bytes for r in again.values(hashed, "bytes").collect()} == {f"p{i}": str(i % 40) for i in range(200)}
    assert again.values(hashed, "other").where("other is not null").isEmpty()


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = scoring.MeasureCache(spark, str(tmp_path / "cache"), 8)
    spark.range(500).select(F.lit("bytes"), F.sha2(F.col("id").cast("string"), 256), F.lit("1")).write.insertInto(cache.name)
    asked = spark.range(100).select(F.col("id").cast("string").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    for df in (cache.lacking(asked, "bytes"), cache.values(asked, "bytes")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        assert "Exchange" not in plan.split("Range (0, 100")[1] and "SelectedBucketsCount: 8 out of 8" in plan


class Watched:
    """A file that says how many bytes were read of it."""

    def __init__(self, f):
        self.f, self.bytes = f, 0

    def read(self, n):
        out = self.f.read(n)
        self.bytes += len(out)
        return out

    def seek(self, at):
        return self.f.seek(at)


def test_only_headers_are_read(spark, tmp_path):
    import io
    import struct

    good = audio.wav_bytes(np.zeros(200_000), 48000, "PCM_24")
    extra = good[:12] + b"LIST" + struct.pack("<I", 90_001) + b"x" * 90_002 + good[12:]
    (tmp_path / "wav").mkdir()
    cases = {"good": good, "extra": extra, "stereo": audio.wav_bytes(np.zeros((10, 2)), 44100), "cut": good[:30], "not": b"no sound", "empty": b"", "head": good[:44], "odd": good[:20] + b"\x63" + good[21:]}
    for name, content in cases.items():
        (tmp_path / "wav" / f"{name}.wav").write_bytes(content)
        f = Watched(io.BytesIO(content))
        assert audio.said_of(f, 48000) == audio.said_of(io.BytesIO(content), 48000) and f.bytes < 100
    paths = spark.createDataFrame([(str(tmp_path / "wav" / f"{n}.wav"),) for n in cases], "path string")
    found = {r.path.rsplit("/", 1)[-1][:-4]: r.problems for r in audio.scanned_headers(paths).collect()}
    listed = audio.scanned_headers(binary_files(spark, str(tmp_path / "wav")).select("path")).collect()
    assert {r.path.rsplit("/", 1)[-1][:-4]: r.problems for r in listed} == {n: p for n, p in found.items() if n != "empty"}
    assert found["good"] == found["extra"] == found["head"] == "" and found["stereo"] == "44100 Hz; 2 channels"
    assert all(found[n].startswith("not WAV") for n in ("cut", "not", "empty", "odd"))
    assert audio.header(extra).frames == 200_000 and len(audio.samples(extra, audio.header(extra))) == 200_000


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "n int, s string")
    rules = {"n is positive": F.col("n") > 0, "n is one": F.col("n") == 1, "s is there": F.col("s").isNotNull()}
    assert {r.rule: r.rows for r in gates.violations(df, rules).collect()} == {"n is positive": 1, "n is one": 2, "s is there": 1}
    assert gates.violations(df.limit(0), rules).agg(F.sum("rows")).first()[0] == 0
    assert gates.require(df.where("n = 1"), rules).count() == 1
    with pytest.raises(Exception, match="breaks the rule 's is there'"):
        gates.require(df.where("n > 0"), {"s is there": F.col("s").isNotNull()}).collect()


def test_binomial_tails(spark):
    rows = [(k, n) for n in (0, 1, 14, 60, 400) for k in range(0, n + 1, max(1, n // 9))] + [(-1, 5), (6, 5), (None, 4)]
    found = spark.createDataFrame(rows, "k int, n int").withColumn("p", stats.binomial_tail_of(F.col("k"), F.col("n"))).collect()
    for r in found:
        if r.k is None:
            assert r.p is None
        else:
            assert r.p == pytest.approx(stats.binomial_tail(max(r.k, 0), r.n) if r.k <= r.n else 0.0, rel=1e-9, abs=1e-300)
    assert stats.binomial_tail_of is not None and round(stats.binomial_tail(13, 14), 3) == 0.001


def test_robust_z_keeps_every_row(spark):
    rows = [("a", float(i)) for i in range(9)] + [(None, 1.0), (None, 2.0), (None, 9.0), ("b", None)]
    found = stats.robust_z(spark.createDataFrame(rows, "style string, r double"), ["style"], "r").collect()
    assert len(found) == len(rows)
    of = {(r.style, r.r): r.z for r in found}
    assert of["b", None] is None and of[None, 2.0] == 0 and math.isclose(of[None, 9.0], 0.6745 * 7 / 1) and of["a", 4.0] == 0


def test_american_spellings(spark):
    same = "four hour our tour exercise surprise advise promise rise wise yelled telling dialogue paradise raise noise analyses centred"
    assert [english.american(w) for w in same.split()] == same.split()
    pairs = "colour:color favourite:favorite harbours:harbors organise:organize organisation:organization realised:realized analyse:analyze travelled:traveled centre:center theatres:theaters catalogue:catalog grey:gray defence:defense"
    for pair in pairs.split():
        british, own = pair.split(":")
        assert english.american(british) == own == english.american(own)
    assert english.english_words("The colour is forty-five.") == english.english_words("the color is 45")


def scored_rows(texts):
    return [("v0", "sad", "short", k, 11, f"c{k}", r, h, None, 0.5, 0.5, 0.5) for k, (r, h) in enumerate(texts)]


def test_score_takes_texts_by_a_normaliser(spark):
    schema = "run string, style string, grp string, item_id long, seed long, clip_id string, ref string, hyp string, problem string, arousal double, voicing double, speaker_sim double"
    rows = spark.createDataFrame(scored_rows([("The colour of forty five boats.", "the color of 45 boats"), ("It's grey, Mr. Smith", "it is gray mister smith"), ("one two three", None)]), schema)
    told = {r.clip_id: (r.errors, r.words) for r in workflows.score(rows)["clips"].collect()}
    assert told == {"c0": (0, 5), "c1": (0, 5), "c2": (3, 3)}
    plain = {r.clip_id: r.errors for r in workflows.score(rows, normaliser="plain")["clips"].collect()}
    assert plain["c0"] == 3 and plain["c2"] == 3


def test_english_errors_of_the_turns(spark):
    data = "/root/testdata/sf0.001"
    found = {(r.conv_id, r.turn): (r.words, r.errors) for r in registry.queries()["o9_15_english_errors"](spark, data).collect()}
    from loomline.functions.align import edit_distance

    rows = {(r.conv_id, r.turn): english.english_words(r.text) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    assert found == {(c, t): (len(w), edit_distance(w, rows[c, t + 1])) for (c, t), w in rows.items() if (c, t + 1) in rows}


def test_prepare_loses_no_row(spark):
    """Null pace and style, changed clips, and recordings whose segments must stay together."""
    rows = []
    for k in range(240):
        rows.append((f"s{k:03d}", ("default", "sad")[k % 2], f"text number {k}", f"text number {k}", f"h{k}", 2.0 + k % 3 / 10, [], f"f{k // 4}", float(k % 4), k % 4 + 0.9, 0, 0.0))
    rows[5] = (*rows[5][:5], None, *rows[5][6:])
    rows[6] = (*rows[6][:5], 0.0, *rows[6][6:])
    rows[7] = (rows[7][0], None, *rows[7][2:])
    rows[8] = (*rows[8][:10], 3, 0.0)
    rows[9] = (*rows[9][:10], 0, 0.2)
    rows[10] = (*rows[10][:10], None, None)
    rows[11] = (*rows[11][:6], [("too_short", "x")], *rows[11][7:])
    schema = "stem string, style string, text string, norm string, sha256 string, duration_s double, issues array<struct<code:string,detail:string>>, source_file string, start_s double, end_s double, length_error int, level_error_db double"
    made = workflows.prepare(spark.createDataFrame(rows, schema))
    out = {r.id: list(r.reasons) for r in made["exclusions"].collect()}
    assert out == {"s005": ["unknown_pace"], "s006": ["unknown_pace"], "s008": ["resample_changed"], "s009": ["resample_changed"], "s010": ["resample_changed"], "s011": ["too_short"]}
    examples = made["examples"].collect()
    assert len(examples) + len(out) == 240
    splits_of = {}
    for r in examples:
        splits_of.setdefault(r.source_file, set()).add(r.split)
    assert all(len(s) == 1 for s in splits_of.values())
    assert made["violations"].where("`check` in ('key in two splits', 'overlapping segments in two splits', 'repeated id')").isEmpty()


def test_provenance_rows(spark, tmp_path):
    write_files(spark.createDataFrame([("a/x.txt", bytearray(b"one")), ("y.txt", bytearray(b"two"))], "name string, content binary"), str(tmp_path / "got"))
    found = {r.file: (r.source, r.bytes, r.md5) for r in sinks.provenance_rows(binary_files(spark, str(tmp_path / "got"), "*"), str(tmp_path / "got"), "there").collect()}
    assert found == {"a/x.txt": ("there", 3, "f97c5d29941bfb1b2fdab0874906ab82"), "y.txt": ("there", 3, "b8a9f715dbb64fd5c56e7783c6820a61")}
