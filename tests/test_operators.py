"""Splits, relations, gates, evaluation, audio and scoring on planted cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import audio, evaluation, gates, relations, scoring, splits
from loomline.operators.components import connected_components

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
KEYS = ["norm", "sha"]


def example_rows(n, styles, start=0, seed=1):
    rng = random.Random(seed)
    return [(start + i, rng.choice(styles), f"n{rng.randint(0, n)}", None if i % 9 == 0 else f"s{rng.randint(0, 4 * n)}", 1.0) for i in range(n)]


SCHEMA = "id long, style string, norm string, sha string, duration_s double"


def plain_groups(rows):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in (2, 3):
        first = {}
        for r in rows:
            if r[k] is not None:
                a, b = find(r[0]), find(first.setdefault(r[k], r[0]))
                root[max(a, b)] = min(a, b)
    return {r[0]: f"g_{find(r[0])}" for r in rows}


def test_groups_and_splits(spark):
    rows = example_rows(800, ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    groups = splits.group_examples(df, "id", KEYS)
    assert {r.id: r.group_id for r in groups.collect()} == plain_groups(rows)
    joined = df.join(groups, "id")
    placed = joined.join(splits.place_groups(joined, RATIOS, 7), "group_id")
    assert placed.count() == 800
    assert splits.verify_splits(placed, RATIOS, [*KEYS, "group_id"]).collect() == []
    again = joined.repartition(9).join(splits.place_groups(joined.repartition(5), RATIOS, 7), "group_id")
    assert placed.select("id", "split").exceptAll(again.select("id", "split")).isEmpty()


def test_verify_finds_planted_faults(spark):
    rows = [(1, "a", "x", "s", 1.0, "train"), (1, "a", "y", "t", 1.0, "train"), (2, "a", "x", "u", 1.0, "test"), (3, "b", "z", "v", 1.0, "nowhere")]
    df = spark.createDataFrame(rows, SCHEMA + ", split string")
    found = {r.check for r in splits.verify_splits(df, RATIOS, KEYS).collect()}
    assert found == {"repeated id", "unknown split", "key in two splits", "share of split", "style missing in split", "share of style"}


def test_extension(spark):
    old = spark.createDataFrame(example_rows(300, ["a", "b"]), SCHEMA)
    joined = old.join(splits.group_examples(old, "id", KEYS), "id")
    frozen = joined.join(splits.place_groups(joined, RATIOS, 1), "group_id").select("id", "style", *KEYS, "duration_s", "group_id", "split")
    fresh = [(1000 + i, "c", f"new{i // 2}", f"fresh{i}", 1.0) for i in range(100)]
    first = frozen.orderBy("id").first()
    fresh.append((2000, "c", first.norm, "other", 1.0))  # joins an old component
    new = spark.createDataFrame(fresh, SCHEMA)
    grown = splits.extend_splits(frozen, new, KEYS, RATIOS, 1)
    assert grown.count() == 401 and relations.added_only(frozen, grown).isEmpty() and relations.leaks(grown, KEYS).isEmpty()
    late = grown.where("id = 2000").first()
    assert late.split == first.split and late.group_id == first.group_id
    with pytest.raises(ValueError, match="already"):
        splits.extend_splits(frozen, old.limit(1), KEYS, RATIOS, 1)
    a, b = (frozen.where(f"split = '{s}'").first() for s in ("train", "test"))
    torn = spark.createDataFrame([(3000, "c", a.norm, b.sha or "s", 1.0), (3001, "c", b.norm, b.sha or "s", 1.0)], SCHEMA)
    with pytest.raises(ValueError, match="two splits"):
        splits.extend_splits(frozen, torn, KEYS, RATIOS, 1)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 164)]
    star = [(5, 1000 + i) for i in range(200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 165)) and all(found[1000 + i] == 5 for i in range(200)) and found[7] == 7 and 3 not in found


def test_frozen(spark):
    ids = spark.range(5)
    relations.frozen_or_raise(ids, spark.range(5))
    relations.frozen_or_raise(ids, spark.range(4), refreeze=True)
    with pytest.raises(ValueError, match="1 ids gone"):
        relations.frozen_or_raise(ids, spark.range(4))


def test_reuse(spark):
    saved = spark.createDataFrame([("a", 1)], "file string, x int")
    assert relations.reuse_saved(spark.createDataFrame([("a",)], "file string"), saved, "file").count() == 1
    with pytest.raises(ValueError, match="no saved"):
        relations.reuse_saved(spark.createDataFrame([("b",)], "file string"), saved, "file")


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    a = relations.stratified_sample(df, ["k"], "id", 5, "s")
    b = relations.stratified_sample(df.repartition(13), ["k"], "id", 5, "s")
    assert a.count() == 35 and a.exceptAll(b).isEmpty()
    alone = relations.stratified_sample(df.where("k = 3"), ["k"], "id", 5, "s")
    assert alone.exceptAll(a.where("k = 3")).isEmpty()


def test_blinding(spark):
    df = spark.range(500).withColumn("run", F.lit("v1")).withColumn("text", F.lit("t"))
    trials, key = relations.blinded(df, "id", "secret", ["text"])
    assert trials.columns == ["label", "text"] and key.select("label").distinct().count() == 500 and relations.label_clashes(key).isEmpty()
    sides = {r[0]: r[1] for r in df.select(relations.coin("s", "id").alias("c")).groupBy("c").count().collect()}
    assert set(sides) == {"A", "B"} and min(sides.values()) > 180


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.when(F.col("id") % 2 == 0, "a"))
    a, b = (relations.fingerprint(d, ["id", "x"]).first() for d in (df, df.repartition(7)))
    assert a == b and a != relations.fingerprint(df.where("id > 0"), ["id", "x"]).first()


def test_gates(spark):
    rows = [
        (None, 1, 5.0, 0.0, 0.5, "fine"), ("bad", 2, 0.1, 1.0, 0.0, None), (None, 2, 0.5, 0.5, 0.0001, None),
        (None, 1, 1.0, 0.001, 0.001, "x" * 400), (None, None, 31.0, 0.0, 0.5, "***"), (None, 1, 5.0, 0.0, 0.5, " " + "y" * 401),
    ]
    df = spark.createDataFrame(rows, "error string, channels int, duration_s double, clipping_fraction double, peak double, text string").coalesce(1)
    codes = [[i.code for i in r[0]] for r in df.select(gates.quality_issues()).collect()]
    assert codes == [[], ["corrupt"], ["not_mono", "too_short", "clipping", "near_silent", "no_transcript"], [], ["not_mono", "too_long", "empty_transcript"], ["text_too_long"]]


def test_ranking(spark):
    rows = [("b", "x", 9.0), ("b", "y", 9.0), ("a", "x", 9.0), ("a", "y", 9.0), ("c", "x", 50.0), ("d", "x", 20.0), ("d", "y", 8.0)]
    ranked = gates.speaker_ranking(spark.createDataFrame(rows, "speaker string, style string, duration_s double"), ["x", "y"], 8.0)
    assert [r.speaker for r in ranked.orderBy("place").collect()] == ["a", "b", "d", "c"]


def test_best_attempt(spark):
    rows = [("a", 0, 2, "x"), ("a", 1, 1, "y"), ("a", 2, 1, "y"), ("a", 3, 0, "z"), ("b", 0, 2, "x"), ("b", 1, 2, "x"), ("c", 0, 0, "k"), ("c", 1, 2, "k")]
    found = evaluation.best_attempt(spark.createDataFrame(rows, "k string, attempt int, severity int, heard string"), ["k"])
    assert {r.k: (r.attempt, r.severity, r.tries) for r in found.collect()} == {"a": (1, 1, 3), "b": (0, 2, 2), "c": (0, 0, 1)}


def test_best_checkpoint(spark):
    losses = spark.createDataFrame([(1, 2.0, 1), (2, 1.0, 2), (1, 1.0, 3), (3, 0.5, 4)], "step long, loss double, line int")
    assert tuple(evaluation.best_checkpoint(losses, spark.createDataFrame([(1,), (2,)], "step long")).first()) == (2, 1.0)


def test_pair_answers(spark):
    key = spark.createDataFrame([("1", "v1", "A"), ("2", "v1", "B"), ("3", "reference", "A"), ("4", "a", "A")], "label string, run string, side string")
    answers = spark.createDataFrame([("1", "A"), ("2", "same"), ("3", "B"), ("4", ""), ("9", "A")], "label string, answer string")
    rows = [tuple(r) for r in evaluation.pair_answers(answers, key).collect()]
    assert rows == [("v1", 2, 0.5, 0.0, 0.5), ("reference", 1, 0.0, 1.0, 0.0)]


def test_classifier(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(3 * (i % 3), 0.5, 4)], int(i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    _, found = evaluation.style_classifier(df.where("id < 90"), df.where("id >= 90"), "v", "label", folds=2, regs=(0.01, 1.0))
    assert found.where("label = prediction").count() == 30


def wave(seconds=1.0, rate=16000, hz=220.0, level=0.5):
    t = np.arange(int(seconds * rate)) / rate
    return level * np.sin(2 * np.pi * hz * t)


@pytest.mark.parametrize(("subtype", "tolerance"), [("PCM_16", 1e-4), ("PCM_24", 1e-6), ("PCM_32", 1e-6), ("FLOAT", 1e-7)])
def test_decode(subtype, tolerance):
    x = np.stack([wave(), -wave(hz=330)], 1)
    raw = audio.wav_bytes(x, 16000, subtype)
    h = audio.header(raw)
    assert (h.subtype, h.channels, h.frames) == (subtype, 2, 16000)
    assert np.abs(audio.samples(raw, h) - x).max() < tolerance


def test_measure():
    x = np.concatenate([np.zeros(1600), wave(0.5), np.zeros(3200)])
    m = audio.measure(audio.wav_bytes(x, 16000, "FLOAT"))
    assert m["error"] is None and m["peak"] == 0.5 and m["clipping_fraction"] == 0
    assert m["lead_silence_s"] == pytest.approx(0.1) and m["trail_silence_s"] == pytest.approx(0.2) and m["active_fraction"] == pytest.approx(0.625, abs=0.02)
    assert m["speech_level_dbfs"] == pytest.approx(20 * math.log10(0.5 / math.sqrt(2)), abs=0.1) and m["noise_floor_dbfs"] == -200
    loud = audio.measure(audio.wav_bytes(np.ones(1600), 16000, "FLOAT"))
    assert loud["clipping_fraction"] == 1.0 and loud["rms_dbfs"] == 0
    short = audio.measure(audio.wav_bytes(wave(0.05), 16000))
    assert short["noise_floor_dbfs"] is None and short["rms_dbfs"] is not None


def test_measure_never_raises():
    good = audio.wav_bytes(wave(), 16000)
    assert audio.measure(None)["error"].startswith("unreadable") and audio.measure(b"RIFFxxxxWAVE")["error"].startswith("unreadable")
    assert audio.measure(audio.wav_bytes(np.empty(0), 16000))["error"] == "empty audio"
    assert "header says" in audio.measure(good[:-1000])["error"]
    nan = wave()
    nan[7] = np.nan
    assert audio.measure(audio.wav_bytes(nan, 16000, "FLOAT"))["error"] == "1 non-finite samples"


@pytest.mark.parametrize("hz", [80.0, 147.0, 220.0, 400.0])
def test_pitch(hz):
    p = audio.pitch_profile(audio.wav_bytes(wave(1.0, 22050, hz), 22050))
    assert p["f0_median_hz"] == pytest.approx(hz, rel=0.01) and p["f0_range_st"] < 0.1 and p["voiced_fraction"] > 0.9


def test_gliding_pitch_is_followed():
    """A tone that rises by an octave, with a stronger second harmonic and a pause: no octave errors, and the pause is unvoiced."""
    t = np.arange(24000) / 16000
    hz = 120 * 2 ** (t / 1.5)
    phase = 2 * np.pi * np.cumsum(hz) / 16000
    x = 0.1 * np.sin(phase) + 0.2 * np.sin(2 * phase)
    x[9600:12800] = 0
    f0 = audio.pitch_track(x)
    middle = (np.arange(len(f0)) * 256 + 512) / 16000
    want, voiced = 120 * 2 ** (middle / 1.5), np.isfinite(f0)
    assert np.mean(np.abs(f0[voiced] / want[voiced] - 1) < 0.04) > 0.95
    assert not voiced[(middle > 0.66) & (middle < 0.74)].any() and voiced[(middle < 0.55) | (middle > 0.9)].mean() > 0.95


def test_noise_has_no_pitch():
    noise = 0.3 * np.random.default_rng(0).normal(size=16000)
    p = audio.pitch_profile(audio.wav_bytes(noise, 16000))
    assert p["voiced_fraction"] < 0.1 and p["f0_median_hz"] is None


def test_resample():
    for to in (16000, 24000, 44100):
        r = audio.prepared(audio.wav_bytes(np.stack([wave(rate=48000), np.zeros(48000)], 1), 48000, "PCM_24"), to)
        assert r["length_error"] <= 2 and r["level_error_db"] < 0.1
        y = audio.samples(r["wav"], audio.header(r["wav"]))[:, 0]
        assert np.abs(y[500:-500] - wave(rate=to)[500 : len(y) - 500]).max() < 1e-3


def test_end_gap():
    assert audio.end_gap(audio.wav_bytes(wave(), 16000)) == pytest.approx(0, abs=0.2)
    assert audio.end_gap(audio.wav_bytes(np.concatenate([wave(), np.zeros(3200)]), 16000, "FLOAT")) > 100
    assert audio.end_gap(b"") is None


def test_inventory(spark, tmp_path):
    from loomline.sources.files import binary_files

    for k in range(3):
        (tmp_path / f"ex01_sad_{k}.wav").write_bytes(audio.wav_bytes(wave(2.0), 48000))
    (tmp_path / "ex01_sad_9.wav").write_bytes(b"junk")
    texts = spark.createDataFrame([("ex01_sad_0", "hello"), ("ex01_sad_1", "again")], "stem string, text string")
    sample = spark.createDataFrame([("ex01_sad_1",)], "stem string")
    rows = {r.stem: r for r in audio.inventory(binary_files(spark, str(tmp_path)), texts, sample).collect()}
    assert [i.code for i in rows["ex01_sad_0"].issues] == ["too_short"] and rows["ex01_sad_1"].voiced_fraction is not None
    assert [i.code for i in rows["ex01_sad_9"].issues] == ["corrupt"] and rows["ex01_sad_0"].voiced_fraction is None
    assert [i.code for i in rows["ex01_sad_2"].issues] == ["too_short", "no_transcript"]


class Counting:
    measure = "length"

    def load(self):
        return lambda contents: contents.map(len)


def test_cache(spark):
    files = spark.createDataFrame([("a", bytearray(b"xx")), ("b", bytearray(b"xx")), ("c", bytearray(b"yyy"))], "path string, content binary")
    empty = spark.createDataFrame([], "measure string, sha256 string, value string")
    new = scoring.extend_cache(files, empty, Counting()).collect()
    assert sorted(r.value for r in new) == ["2", "3"]
    cache = spark.createDataFrame(new)
    assert scoring.extend_cache(files, cache, Counting()).isEmpty()
    assert {r.path: r.length for r in scoring.cached_values(files, cache, "length").collect()} == {"a": "2", "b": "2", "c": "3"}


def test_pitch_of_clips_taken_together():
    """Clips of many lengths, among them none, tracked at once: each as if it were alone, tones at their pitch."""
    rng = np.random.default_rng(3)
    tones = [0.3 * np.sin(2 * np.pi * f * np.arange(n) / 16000) for f, n in ((110, 9000), (220, 3000), (330, 24000), (150, 0), (150, 1200))]
    clips = [*tones, np.zeros(5000), 0.1 * rng.standard_normal(7000), *tones[:3] * 30]
    together = audio.pitch_tracks(clips)
    assert all(np.array_equal(a, audio.pitch_track(x), equal_nan=True) for a, x in zip(together, clips[:8]))
    assert [round(float(np.nanmedian(t))) for t in together[:3]] == [110, 220, 330] and len(together[3]) == len(together[4]) == 0 and np.isnan(together[5]).all()


def test_resampling_places_are_exact():
    """Places that fall on input samples, which quotients in doubles miss by a rounding."""
    x = np.random.default_rng(1).standard_normal(700)
    y, reach = audio.resampled(x, 7, 5), 45
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + 1)])
    for i in range(0, 500, 5):  # sample i lies on input sample 7 i / 5
        d = -np.arange(-reach + 1, reach + 1)
        want = (padded[7 * i // 5 + 1 : 7 * i // 5 + 1 + 2 * reach] * np.sinc(d * 5 / 7) * np.i0(10 * np.sqrt(np.maximum(0, 1 - (d / reach) ** 2))) / np.i0(10)).sum() * 5 / 7
        assert abs(y[i] - want) < 1e-9


def test_rounds_of_components_shrink(spark, monkeypatch):
    """Edges of a round are those between the roots of the one before, each once."""
    from loomline.operators import components

    real, left = components.cut_lineage, []

    def seen(df, *name):
        out = real(df, *name)
        left.extend([out.count()] if out.columns == ["a", "b"] else [])
        return out

    monkeypatch.setattr(components, "cut_lineage", seen)
    edges = [(i, 1000 + i % 7) for i in range(300)] + [(i, i + 1) for i in range(2000, 2064)] + [(5, 5), (9999, 9999)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert left == sorted(left, reverse=True) and left[0] == len(edges) and left[1] < 300 and left[-1] == 0 and len(left) <= 4
    assert all(found[i] == i % 7 for i in range(300)) and all(found[i] == 2000 for i in range(2000, 2065)) and found[9999] == 9999


def test_verification_makes_its_rows_once(spark):
    """What the checks read is a written table, not the plan of the rows."""
    df = spark.createDataFrame(example_rows(30, ["a", "b"]), SCHEMA).withColumn("split", F.lit("train")).withColumn("slow", F.rand(1))
    plan = splits.verify_splits(df, RATIOS, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "verified" not in plan and "LogicalRDD" not in plan and "rand(" not in plan and plan.count("Relation [") >= 6


def test_hiss_before_a_tone_is_not_voiced():
    """Clips whose hiss the path alone follows for five frames and more: the voiced share is the tone's."""
    from loomline.plans.graphs import half_voiced_clips

    ids = [7511, 43476, 26542, 42188, 49804]
    assert [round(p["voiced_fraction"], 1) for p in audio.pitch_profiles(half_voiced_clips(ids))] == [round(1 - i % 5 / 5, 1) for i in ids]
