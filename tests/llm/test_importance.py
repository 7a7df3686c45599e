"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from loomline.llm import importance

from .conftest import ordered
from .test_plans import final_plan

BUCKETS = 10_000
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, target, percent=5):
    mine, theirs = Counter(), Counter()
    of = [features(t) for _, t in rows]
    for _, f in of:
        mine.update(f)
    for t in target:
        theirs.update(features(t)[1])
    s, t = sum(mine.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (s + BUCKETS) / ((mine[b] + 1) * (t + BUCKETS))))
    out = []
    for (i, _), (n, f) in zip(rows, of):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return ordered(out)


def target_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")


def test_resampling(spark, docs, rows):
    texts = [rows[3][1], rows[70][1], None, "", "Über-path the stone"]
    for percent in (5, 50):
        found = importance.resample(docs, target_of(spark, texts), percent=percent)
        assert found.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
        assert ordered(found.collect()) == plain(rows, texts, percent)


def test_empty_sides(spark, docs, rows):
    assert importance.resample(docs.limit(0), target_of(spark, ["a b"])).count() == 0
    assert ordered(importance.resample(docs, target_of(spark, [])).collect()) == plain(rows, [])


def test_ranks_over_many_equal_rows(spark):
    """A third of all rows is one row: its copies are ranked one by one."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text)] * 400 + [(None, text)] * 20 + [(i, " ".join(f"v{(i * j) % 97}" for j in range(5 + i % 40))) for i in range(100, 900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = importance.resample(docs, target_of(spark, [text]), percent=60).collect()
    assert ordered(found) == plain(rows, [text], 60)


def test_it_is_native(spark, docs):
    plan = final_plan(importance.resample(docs, target_of(spark, ["a b c"])))
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_texts(spark):
    """Upper case beyond A-Z stays, control characters part words, and runs of separators are one."""
    rows = [(1, "ÀB\x00c--D\x7fE  é1"), (2, " lead"), (3, "trail. "), (4, "."), (5, "x" * 100_000), (6, "İSTANBUL ǅ 漢字 😀b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert ordered(importance.resample(docs, target_of(spark, ["é1", "b"])).collect()) == plain(rows, ["é1", "b"])
