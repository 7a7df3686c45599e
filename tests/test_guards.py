"""Operators that abort: rediscovery, fingerprints, speaker choice, extended evaluation sets, blinded pages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomline.functions import stats
from loomline.operators import evaluation, gates, relations
from loomline.sinks import files


def test_rediscovered_ids_must_be_there_once(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, x string")
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "id long")
    assert sorted(r.x for r in relations.rediscovered(ids(1, 3, 3), items, "id").collect()) == ["a", "c"]
    with pytest.raises(ValueError, match="1 old ids"):
        relations.rediscovered(ids(1, 9), items, "id")
    with pytest.raises(ValueError, match="1 are found more"):
        relations.rediscovered(ids(1), items.union(items), "id")


def test_fingerprint_guards_the_data(spark):
    df = spark.range(50).withColumn("x", F.col("id") % 7)
    digest = relations.fingerprint_or_raise(df, ["id", "x"], None)
    assert relations.fingerprint_or_raise(df.repartition(5).orderBy("x"), ["id", "x"], digest) == digest
    with pytest.raises(ValueError, match="recorded"):
        relations.fingerprint_or_raise(df.withColumn("x", F.col("x") + 1), ["id", "x"], digest)


def test_speaker_is_pinned_or_best(spark):
    rows = spark.createDataFrame([(1, "ann", True), (2, "bob", True), (3, "cyd", False)], "place int, speaker string, eligible boolean")
    assert gates.select_speaker(rows) == "ann" and gates.select_speaker(rows, "bob") == "bob"
    for bad in (lambda: gates.select_speaker(rows, "cyd"), lambda: gates.select_speaker(rows.where("not eligible"))):
        with pytest.raises(ValueError, match="eligible"):
            bad()


def test_eval_set_only_grows(spark):
    items = spark.createDataFrame([(1, {"calm": 10}), (2, {"calm": 20})], "item_id long, refs map<string,long>")
    more = spark.createDataFrame([(i, s, i * 100 + len(s)) for i in (1, 2) for s in ("sad", "loud")], "item_id long, style string, ref long")
    history = spark.createDataFrame([("day 1", "calm")], "at string, styles string")
    grown, log = evaluation.extend_eval_set(items, more, history, "day 2")
    assert {r.item_id: r.refs for r in grown.collect()} == {1: {"calm": 10, "sad": 103, "loud": 104}, 2: {"calm": 20, "sad": 203, "loud": 204}}
    assert sorted(map(tuple, log.collect())) == [("day 1", "calm"), ("day 2", "loud,sad")]
    with pytest.raises(ValueError, match="already"):
        evaluation.extend_eval_set(grown, more, history, "day 3")
    with pytest.raises(ValueError, match="1 items lack"):
        evaluation.extend_eval_set(items, more.where("item_id = 1 or style = 'sad'"), history, "day 2")


def test_blinded_page_and_its_key(tmp_path):
    trials, key = [{"label": "c1<", "text": "one & two"}], {"c1<": {"run": "v7"}}
    page = files.blinded_page(tmp_path / "pages", "set-b", "Listening", trials, key, tmp_path / "keys", ["v7", "sad"])
    text = page.read_text()
    assert "one &amp; two" in text and "v7" not in text and json.loads((tmp_path / "keys" / "set-b.key.json").read_text()) == key
    with pytest.raises(ValueError, match="outside"):
        files.blinded_page(tmp_path / "pages", "set-b", "Listening", trials, key, tmp_path / "pages" / "keys", [])
    with pytest.raises(ValueError, match="give away"):
        files.blinded_page(tmp_path / "pages", "set-v7", "Listening", trials, key, tmp_path / "keys", ["v7"])
    assert files.remove_tree(tmp_path / "pages") and files.remove_tree(tmp_path / "pages")


def test_order_statistics_of_one_hot_group(spark):
    """Nearly all rows in one group: exact quantiles, and no task that holds the group."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=3000).round(4).tolist()
    rows = [("hot", v, int(v * 10)) for v in x] + [("b", 1.0, 1), ("b", 2.0, 4), (None, 5.0, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, n int")
    found = {r.k: r for r in stats.order_statistics(df, ["k"], {"mid": ("x", 0.5), "p10": ("x", 0.1), "low": ("n", 0.95)}, ("low",)).collect()}
    assert found["hot"].mid == pytest.approx(np.median(x)) and found["hot"].p10 == pytest.approx(np.percentile(x, 10))
    assert found["hot"].low == sorted(int(v * 10) for v in x)[int(0.95 * 2999)]
    assert (found["b"].mid, found["b"].low) == (1.5, 1) and found[None].mid == 5.0 and found[None].low is None and "none" not in found
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in stats.counted_below(df, ["k"], "x").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    placed = {r.x: r.place for r in stats.places(df.where("k = 'b'"), ["k"], ["x"]).collect()}
    assert placed == {1.0: 1, 2.0: 2}


def test_written_tables_go_with_their_process(spark, tmp_path, monkeypatch):
    """What cuts lineage lasts until the process ends, and only that process removes it."""
    from loomline.operators import components

    monkeypatch.setattr(components, "WRITTEN", [])
    df = components.cut_lineage(spark.range(10), "kept")
    (process, path), = components.WRITTEN
    path = path.removeprefix("file:")
    assert df.count() == 10 and os.path.isdir(path) and process == os.getpid()
    components.WRITTEN[:] = [(process + 1, path), (process, "s3://store/x")]
    components.remove_written()
    assert os.path.isdir(path) and components.WRITTEN == []
    components.WRITTEN.append((process, path))
    components.remove_written()
    assert not os.path.isdir(path)


def test_measures_and_lists_are_told_apart(spark):
    clips = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, stem string")
    once = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, x double")
    assert sorted(r.stem for r in relations.with_measures(clips, once, "id").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="measured twice"):
        relations.with_measures(clips, once.union(once.limit(1)), "id").collect()
    a = spark.createDataFrame([(1, "train"), (2, "test"), (3, "test")], "id int, split string")
    b = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test"), (3, "test")], "id int, split string")
    assert {r.split: r.differing for r in relations.differing_ids(a, b, "id").collect()} == {"train": 1, "test": 1}
