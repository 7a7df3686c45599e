"""Quality, substrings, suffixes and decontamination against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import decontam, quality, segments, substrings, suffixes
from loomline.llm.common import ALNUM

from .conftest import ordered


def plain_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeat = len(words), len(inside)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def test_quality_counts(docs, rows):
    found = ordered(r[:7] for r in quality.quality_cascade(docs).collect())
    assert found == ordered((i, *plain_quality(t)) for i, t in rows)


def test_quality_verdict_does_not_depend_on_the_order(docs):
    a = ordered(quality.quality_cascade(docs).collect())
    assert a == ordered(quality.quality_cascade(docs, rules=tuple(reversed(quality.RULES))).collect())
    kept = {r.doc_id for r in quality.quality_cascade(docs).collect() if r.kept}
    assert {0, 1, 100, 200, 310} <= kept and not kept & {303, 306, 309, 312, 313}


def test_quality_filter_keeps_rows_whole(docs):
    found = quality.quality_filter(docs)
    assert found.columns == docs.columns
    kept = [r.doc_id for r in quality.quality_cascade(docs).collect() if r.kept]
    assert sorted(kept, key=str) == sorted((r.doc_id for r in found.collect()), key=str)


def test_order_is_by_rejection_per_cost():
    cheap, dear = quality.Rule("cheap", lambda d: True), quality.Rule("dear", lambda d: sum(range(20000)) < 0)
    assert [r.name for r in quality.measured_order([b"a b c"] * 20, (dear, cheap))] == ["cheap", "dear"]


def plain_repeats(rows, width, units, keep_first=False):
    places = defaultdict(list)
    seqs = [units(t) for _, t in rows]
    for k, u in enumerate(seqs):
        for a in range(len(u) - width + 1):
            places[tuple(u[a : a + width])].append((k, a))
    gone = [set() for _ in rows]
    for found in places.values():
        for k, a in found[keep_first:] if len(found) > 1 else ():
            gone[k].update(range(a, a + width))
    return seqs, gone


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 3000, "hot": 2}])
@pytest.mark.parametrize("window", [35, 12])
def test_word_repeats(docs, rows, window, sizes):
    seqs, gone = plain_repeats(rows, window, lambda t: (t or "").encode().split())
    want = []
    for (i, _), u, g in zip(rows, seqs, gone):
        kept = [w for k, w in enumerate(u) if k not in g]
        want.append((i, len(u), len(g), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert sum(w[2] for w in want) > 500
    assert ordered(substrings.word_repeats(docs, window=window, **sizes).collect()) == ordered(want)


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 3000, "hot": 2}])
def test_byte_repeats(docs, rows, sizes):
    seqs, gone = plain_repeats(rows, 200, lambda t: (t or "").encode())
    want = []
    for (i, _), u, g in zip(rows, seqs, gone):
        kept = bytes(b for k, b in enumerate(u) if k not in g)
        want.append((i, len(u), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(kept).hexdigest()))
    assert sum(w[2] for w in want) > 1000
    assert ordered(suffixes.byte_repeats(docs, keep_first=False, **sizes).collect()) == ordered(want)


def test_first_copy_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (2, "a " + text + " b")], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.n_removed for r in substrings.word_repeats(docs, keep_first=True).collect()}
    assert found == {1: 0, 2: 50}
    found = {r.doc_id: r.kept for r in suffixes.byte_repeats(docs, window=100, with_kept=True).collect()}
    assert bytes(found[1]) == text.encode() and bytes(found[2]) == b"a  b"


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 3000, "hot": 2}])
def test_first_copies_stay_in_every_row(spark, rows, sizes):
    """keep_first against the plain version: of each window the first place in row order stays, hot or not."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for found, width, units in (
        (substrings.word_repeats(docs, keep_first=True, **sizes), 35, lambda t: (t or "").encode().split()),
        (suffixes.byte_repeats(docs, **sizes), 200, lambda t: (t or "").encode()),
    ):
        seqs, gone = plain_repeats(rows, width, units, keep_first=True)
        want = [(i, len(u), len(g)) for (i, _), u, g in zip(rows, seqs, gone)]
        assert ordered(tuple(r)[:3] for r in found.collect()) == ordered(want) and sum(w[2] for w in want) > 300


def test_removed_words_leave_other_columns(docs, rows):
    found = substrings.remove_words(docs)
    assert found.columns == docs.columns and found.count() == len(rows)
    texts = {r.doc_id: r for r in found.collect()}
    assert texts[0].text == dict(rows)[0] and texts[303].text is None
    assert texts[300].text == "" and texts[300].n_chars == 0
    assert len(texts[100].text.split()) == len(dict(rows)[100].split()) - 60


def plain_hits(rows, items):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(ALNUM))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(item)
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        yield i, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("options, bits", [({}, decontam.FILTER_BITS), ({"broadcast_bytes": 0}, 1 << 16), ({}, 64)])
def test_decontamination(spark, docs, rows, options, bits, monkeypatch):
    monkeypatch.setattr(decontam, "FILTER_BITS", bits)
    texts = dict(rows)
    cut = lambda i, a, b: " ".join(texts[i].split()[a:b])
    items = [(1, cut(0, 0, 12)), (2, cut(1, 3, 40).upper()), (2, cut(1, 3, 40)), (10, cut(100, 30, 45)), (3, "two words"), (4, None), (5, ""), (None, "one"), (6, cut(310, 5000, 5010)), (7, cut(5, 0, 9))]
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = decontam.decontaminate(docs, table, **options)
    found = whole.collect()
    want = ordered(plain_hits(rows, items))
    assert ordered(r[:6] for r in found) == want and sum(w[5] for w in want) > 8
    assert all(sum(s.b - s.a for s in r.spans) == r.n_hit and all(x.b < y.a for x, y in zip(r.spans, r.spans[1:])) for r in found)
    clean = decontam.clean_rows(docs, table, **options)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_winnowing_guarantee():
    """Equal windows have equal fingerprints, wherever they stand, and a fingerprint is one of the window's own k-grams."""
    import numpy as np

    from loomline.llm.common import gram_hash

    rng = np.random.default_rng(1)
    for _ in range(50):
        h = rng.integers(0, 40, 60).astype(np.uint64)
        g, fp = gram_hash(h, decontam.K), decontam.fingerprints(h, decontam.SPAN)
        assert len(fp) == 51 and all(fp[a] == g[a : a + 7].min() for a in range(51))
        shared = np.concatenate([rng.integers(50, 90, 9).astype(np.uint64), h[20:32]])
        assert (decontam.fingerprints(shared, decontam.SPAN)[9:] == fp[20:23]).all()


def test_empty_tables(docs):
    none = docs.limit(0)
    assert quality.quality_cascade(none).count() == 0
    assert substrings.word_repeats(none).count() == 0
    assert suffixes.byte_repeats(none).count() == 0
    items = docs.selectExpr("doc_id as item_id", "text")
    assert decontam.decontaminate(none, items).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(docs, items.limit(0)).collect())


def test_a_key_that_every_group_holds_stays_where_it_is(spark):
    """Half of the rows are one key: the totals are those of a plain sum, and no task gathers that key."""
    rows = spark.range(0, 40_000, 1, 16).selectExpr("id AS home", "CASE WHEN id % 2 = 0 THEN 7 ELSE id % 900 + 100 END AS k", "id % 3 AS n")
    totals = [F.sum("n").alias("total"), F.min("home").alias("some_")]
    found = segments.with_totals(rows, "k", "home", totals, "total > 1", share=8, many=800)
    want = rows.join(rows.groupBy("k").agg(*totals).where("total > 1"), "k")
    assert sorted(map(tuple, found.select("home", "k", "n", "total", "some_").collect())) == sorted(map(tuple, want.select("home", "k", "n", "total", "some_").collect()))
    tasks = [r["count"] for r in found.where("k = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 8 and max(tasks) <= 5_000
    again = segments.repeated(rows, "k", "home", share=8, many=800)
    assert again.count() == want.where("n > 0").count()


def test_hot_windows_of_many_groups(spark):
    """One window in 3,000 groups, and others: spans as from a plain count, the hot one's from many tasks."""
    unit = substrings.words(2, 1)
    rows = [(b"hot one", [i], [5], i) for i in range(3000)] + [(b"twice", [i, i], [1, 9], i) for i in range(0, 40, 2)] + [(b"once", [50], [3], 50), (b"two homes", [60], [4], 60), (b"two homes", [61], [2], 61)]
    windows = spark.createDataFrame([(bytearray(p), r, s, h) for p, r, s, h in rows], "packed binary, rows array<bigint>, starts array<bigint>, home bigint").repartition(8)
    for keep_first in (False, True):
        found = segments.hot_spans(unit, windows, keep_first, share=8, many=800)
        spans = sorted(tuple(x) for r in found.collect() for x in np.frombuffer(r.spans, np.int64).reshape(-1, 3).tolist())
        all_places = [(r, s) for p, rs, ss, _ in rows for r, s in zip(rs, ss) if p != b"once"]
        first = {(0, 5), (0, 1), (60, 4)} if keep_first else set()
        assert spans == sorted((r, s, s + 2) for r, s in all_places if (r, s) not in first)
