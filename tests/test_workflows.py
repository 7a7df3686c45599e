"""The three whole runs on a small invented corpus."""

import random

import pytest

from pyspark.sql import functions as F

from loomline.plans import reports, workflows

WORDS = "river stone house light green walk moon seven path water".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    measured, texts = [], []
    for k in range(400):
        speaker, style = ("ex01", "ex02")[k % 2], ("default", "sad")[k // 2 % 2]
        stem = f"{speaker}_{style}_{k:05d}"
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 9)))
        calm = 6.0 if style == "sad" else 0.0
        measured.append((stem, speaker, style, "base", None, f"sha{k if k % 50 else 0}", None, 1, len(text) / (12.0 - calm / 3), 0.0, 0.5, -60.0, -20.0 - calm, 0.9 - calm / 100, 150.0 - calm, 8.0 - calm / 3, 0.6))
        if k % 40 != 7:
            texts.append((stem, text))
    texts.append(("ex09_sad_00001", "nobody"))
    schema = (
        "stem string, speaker string, style string, corpus string, substyle string, sha256 string, error string, channels int, duration_s double, clipping_fraction double, peak double, "
        "noise_floor_dbfs double, speech_level_dbfs double, active_fraction double, f0_median_hz double, f0_range_st double, voiced_fraction double"
    )
    official = [(m[0],) for m in measured if m[0] != measured[3][0]] + [("ex01_gone_1",)]
    return spark.createDataFrame(measured, schema), spark.createDataFrame(texts, "stem string, text string"), spark.createDataFrame(official, "stem string")


def test_inventory_and_prepare(corpus):
    found = workflows.inventory(*corpus)
    counts = {r.finding: r["count"] for r in found["findings"].groupBy("finding").count().collect()}
    assert counts["audio_without_transcript"] == 10 and counts["transcript_without_audio"] == 1
    assert counts["official_not_on_disk"] == 1 and counts["on_disk_not_official"] == 1 and counts["duplicate_audio"] == 1
    assert {r.code: r.clips for r in found["issues"].collect()}["no_transcript"] == 10
    claims = {(r.speaker, r.claim): r.verdict for r in found["claims"].collect()}
    assert claims["ex01", "sad: subdued"] == "supported" and claims["ex02", "default: recording"] == "supported"
    assert all(r.eligible for r in found["ranking"].collect())
    made = workflows.prepare(found["candidates"])
    assert made["violations"].where("`check` not like 'share%'").isEmpty()
    reasons = {r.reasons[0] for r in made["exclusions"].collect()}
    assert "duplicate_audio" in reasons
    total = made["examples"].count() + made["exclusions"].count()
    assert total == found["candidates"].count()
    with pytest.raises(ValueError, match="accepted"):
        workflows.prepare(found["candidates"], workflows.Choice(least_accepted=10_000))
    told = reports.inventory_report(found)
    assert "| duplicate_audio | 1 |" in told and "| no_transcript | 10 |" in told and "## Claims" in told and "| ex01 | default | - | 100 |" in told
    splits = reports.split_report(made)
    total = made["examples"].where("split = 'train'").count()
    assert f"| train | total | {total} |" in splits and "| duplicate_audio |" in splits and splits.index("| train | sad |") < splits.index("| train | total |")
    assert "| default |" in reports.calibration_report(found["clips"], ["f0_median_hz", "speech_level_dbfs"])


def test_score(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        ref = [f"{w}{k}" for w in WORDS]  # no word twice, so the lost end is plain
        hyp = ref if k % 6 else ref[:6]
        rows.append((f"v{k % 2}", "sad" if k % 3 else "default", ("short", "long")[k % 2], k, 11, f"c{k}", ref, hyp, None, rng.random(), rng.random(), rng.random()))
    schema = "run string, style string, grp string, item_id long, seed long, clip_id string, ref array<string>, hyp array<string>, problem string, arousal double, voicing double, speaker_sim double"
    rated = spark.createDataFrame([(f"v{k % 2}", f"c{k}", "sad" if k % 3 else "neutral", str(1 + k % 5)) for k in range(40)], "run string, clip_id string, emotion string, naturalness string")
    out = workflows.score(spark.createDataFrame(rows, schema), rated)
    assert {r.run: (r.k, r.n) for r in out["incomplete"].collect()} == {"v0": (10, 30), "v1": (0, 30)}
    assert {(r.run, r.style): r.wer for r in out["cells"].collect()}["v0", "default"] == pytest.approx(0.4)
    assert sum(r.clips for r in out["completeness"].collect()) == 60 and out["completeness"].first().grp == "short"
    told = reports.score_report(out)
    assert "40.0%" in told and "## Calm clips heard as sad" in told
    assert "## Runs" in reports.completeness_report(out) and "| v1 | 0 | 30 | 0.0% |" in reports.completeness_report(out)
    answered = reports.ratings_report(rated.withColumn("style", F.lit("sad")))
    assert "| run | style | ratings | neutral | sad | mean naturalness |" in answered and "| v0 | sad | 20 | 35% | 65% |" in answered
    assert 0 <= out["rated_auc"].first().auc <= 1 and out["rated_rank"].first().n == 40
