"""Shards, Jaccard join, licenses, packing, archives and pages against plain versions."""

import base64
import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import html, jaccard, licenses, packing, sharding, warc
from loomline.llm.common import ALNUM, LOWER

from .conftest import ordered


def test_shards(spark, docs, rows):
    found = sharding.kd_shards(docs).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert ordered((r.doc_id, r.size, r.text_crc32) for r in found) == ordered((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in found:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.kd_shards(docs.limit(0)).count() == 0


def test_shards_split_one_hot_row(spark, docs):
    hot = docs.where("doc_id = 0").crossJoin(spark.range(960)).drop("id")
    sizes = [r["count"] for r in sharding.kd_shards(hot).groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 4


def test_shard_bytes_are_near_equal(spark):
    many = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(100 + id % 300 as int)) as text", "cast(id % 3 as string) as lang", "'one' as source", "100 + id % 300 as n_chars")
    sizes = [r[0] for r in sharding.kd_shards(many).groupBy("shard").agg({"size": "sum"}).select("sum(size)").collect()]
    assert len(sizes) == 24 and max(sizes) < 1.02 * min(sizes)


def plain_tree(rows, dims, shards, target):
    """The tree by its rules, on collected keys: sort, sum, cut between units nearest the goal. Returns row -> shard."""
    spread = lambda part, c: (max(r[c] for r in part) - min(r[c] for r in part)) if dims[c] else len({r[c] for r in part}) - 1
    whole = {c: spread(rows, c) for c in dims}
    out = {}

    def split(part, first, leaves):
        if leaves == 1 or not part:
            out.update((r["row_"], first) for r in part)
            return
        dim = max(dims, key=lambda c: sharding.width(dims[c], spread(part, c), whole[c]))
        key = lambda r: (r[dim] << sharding.TAIL) + r["tail_"]
        groups = defaultdict(list)
        for r in part:
            groups[key(r) >> sharding.GROUPED].append(r)
        units = []
        for _, g in sorted(groups.items()):
            if sum(r["size"] for r in g) <= sharding.WHOLE * target:
                units.append(g)
            else:
                single = defaultdict(list)
                for r in g:
                    single[key(r)].append(r)
                units += [u for _, u in sorted(single.items())]
        goal, run, cut = sum(r["size"] for r in part) * (leaves // 2) / leaves, 0, 0
        for k, u in enumerate(units):
            size = sum(r["size"] for r in u)
            if run + size >= goal:
                cut = k + 1 if run + size - goal <= goal - run else k
                break
            run += size
        split([r for u in units[:cut] for r in u], first, leaves // 2)
        split([r for u in units[cut:] for r in u], first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [5, 24])
def test_shards_equal_a_plain_tree(spark, docs, shards):
    more = docs.unionByName(docs.withColumn("lang", F.lit("fr")).withColumn("source", F.concat("source", (F.col("doc_id") % 7).cast("string"))).withColumn("doc_id", F.col("doc_id") + 1000))
    slim, dims = sharding.shard_keys(more, "doc_id", "text", ("lang", "source", "n_chars"), 8)
    rows = slim.collect()
    want = Counter()
    for r, shard in plain_tree(rows, dims, shards, sum(r["size"] for r in rows) / shards).items():
        want[shard] += next(x["size"] for x in rows if x["row_"] == r)
    found = Counter()
    for r in sharding.kd_shards(more, shards, fine=0.0).collect():
        found[r.shard] += r.size
    assert found == want


def test_equal_texts_share_a_shard(spark):
    """Copies under other sources and languages lie together, but for a group that outweighs a shard."""
    rows = [(i, f"text {i % 1500} " + "y" * (i % 1500 % 90), "ab"[i % 2], f"s{i % 11}", 10 + i % 5) for i in range(3000)] + [(9000 + i, "hot " * 20, "c", f"s{i % 3}", 80) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shards = defaultdict(set)
    total = Counter()
    texts = {r[0]: r[1] for r in rows}
    for r in sharding.kd_shards(docs).collect():
        shards[texts[r.doc_id]].add(r.shard)
        total[r.shard] += r.size
    assert len(shards.pop("hot " * 20)) > 8
    assert {len(s) for s in shards.values()} == {1}
    assert max(total.values()) < 1.06 * min(total.values())
    assert {r.shard for r in sharding.kd_shards(docs, target_bytes=50_000).collect()} == set(range(-(-sum(total.values()) // 50_000)))


def plain_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"group_bytes": 3000, "set_bytes": 3000}])
@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_jaccard_components(docs, rows, shingle, percent, options):
    found = jaccard.component_ids(docs, shingle=shingle, percent=percent, **options).collect()
    assert ordered(found) == ordered(plain_components(rows, shingle, percent))


def test_links_that_no_star_shows(spark):
    """Chains of texts near the threshold: many components share tokens, and links join them late."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 5)):
            w[at] = f"x{rng.integers(0, 6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shingle, percent in ((1, 92), (2, 85)):
        found = jaccard.component_ids(docs, shingle=shingle, percent=percent, block=5).collect()
        want = plain_components(rows, shingle, percent)
        assert 3 < len({w[2] for w in want}) < 55
        assert ordered(found) == ordered(want)


def test_rows_are_dropped_either_way(spark):
    from loomline.llm.common import ROW, without_rows

    df, bad = spark.range(100).select(F.col("id").alias(ROW), (F.col("id") % 7).alias("x")), spark.range(0, 100, 3).select(F.col("id").alias(ROW))
    for list_bytes in (1 << 20, 0):
        assert sorted(r[0] for r in without_rows(df, bad, list_bytes).collect()) == [i for i in range(100) if i % 3]


def test_join_of_an_empty_table(docs):
    assert jaccard.component_ids(docs.limit(0)).count() == 0
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each(docs, rows):
    kept = jaccard.one_of_each(docs, shingle=5, percent=80)
    assert kept.columns == docs.columns
    groups = defaultdict(list)
    for i, n, c in plain_components(rows, 5, 80):
        groups[c if n else object()].append(i)
    left = Counter(r.doc_id for r in kept.collect())
    assert sum(left.values()) == len(groups) + 0 * len(rows)
    assert left[300] == 0 and left[200] == 1 and left[303] == left[304] == 1


def plain_licenses(text, templates=None, threshold=licenses.THRESHOLD):
    split = lambda t: (t or "").encode().translate(ALNUM).split()
    w = split(text)
    places, base, found = [], set(), {}
    stands = lambda p, ws: any(ws[i : i + len(p)] == p for i in range(len(ws) - len(p) + 1))
    for phrase, label in licenses.PHRASES.items():
        p = split(phrase)
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for t in templates or licenses.templates():
        if not all(stands(split(p), w) for p in t.phrases):
            continue
        tokens, n = set(split(t.text)), licenses.block_words(len(split(t.text)))
        for i in range(len(w)):
            block = w[max(0, i - n + 1) : i + 1]
            share = len(tokens.intersection(block)) / len(tokens)
            if share >= threshold and all(stands(split(p), block) for p in t.phrases):
                found[t.label] = max(share, found.get(t.label, 0))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), max(found.values(), default=0.0)


def test_licenses(docs, rows):
    found = ordered(licenses.license_scan(docs).collect())
    assert found == ordered((i, *plain_licenses(t)) for i, t in rows)
    labels = {r[0]: r[6] for r in found}
    assert "cc-by-nc-4.0" in labels[314] and "gpl-3.0" in labels[315] and labels[316] == "cc-by"
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_containment_index_misses_nothing():
    """Random templates, some with phrases, in random texts, against blocks tried one by one."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(14)]
    hits = 0
    for _ in range(300):
        made = []
        for k in range(6):
            w = rng.choice(words, rng.integers(1, 9)).tolist()
            at = int(rng.integers(0, len(w)))
            made.append(licenses.Template(f"t{k % 4}", " ".join(w), (" ".join(w[at : at + 2]),) if rng.random() < 0.5 else ()))
        index = licenses.ContainmentIndex(tuple(made), {w.encode(): int(rng.integers(1, 50)) for w in words}, 0.8)
        text = " ".join(rng.choice([*words, "x", "y", "z"], rng.integers(0, 40)))
        found = index.matches(text.encode().split())
        want = plain_licenses(text, made, 0.8 - 1e-9)
        assert (",".join(sorted(found)), max(found.values(), default=0.0)) == want[5:]
        hits += len(found)
    assert hits > 100


def best_fit_bins(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweep_of_one_range():
    """Every document takes the smallest gap that holds it; where sequences may be opened that is best-fit decreasing."""
    rng = np.random.default_rng(1)
    for k in range(400):
        capacity, n, opens = int(rng.integers(2, 40)), int(rng.integers(0, 30)), bool(k % 2)
        size, doc = rng.integers(1, capacity + 1, n), rng.random(n) < 0.7
        by = np.lexsort((doc, -size))
        size, doc = size[by], doc[by]
        gap_of, offset, left = packing.sweep(size, doc, capacity, opens)
        gaps, placed = [int(x) for x, d in zip(size, doc) if not d], 0
        for length in (int(x) for x, d in zip(size, doc) if d):
            fits = [g for g in gaps if g >= length] or ([capacity] if opens else [])
            if fits:
                placed += 1
                if min(fits) in gaps:
                    gaps.remove(min(fits))
                gaps.append(min(fits) - length)
        assert placed == (gap_of >= 0).sum()
        assert sorted(left[left > 0].tolist()) == sorted(g for g in gaps if g)
        for at in set(gap_of[gap_of >= 0].tolist()):
            end = capacity - int(size[at]) if not doc[at] else 0
            for o, length in sorted((int(offset[i]), int(size[i])) for i in np.flatnonzero(gap_of == at)):
                assert o == end
                end += length
            assert end + left[at] == capacity


@pytest.mark.parametrize("kind, range_rows", [("uniform", 10**6), ("uniform", 300), ("small", 200), ("third", 250), ("one length", 100)])
def test_rounds_need_no_more_sequences_than_best_fit_decreasing(spark, kind, range_rows):
    rng = np.random.default_rng(3)
    capacity = 64
    made = {"uniform": rng.integers(1, 64, 1500), "small": rng.integers(1, 9, 1500), "third": np.concatenate([np.full(700, 21), rng.integers(1, 64, 900)]), "one length": np.full(700, 13)}
    lengths = made[kind].tolist()
    state = spark.createDataFrame([(packing.OPEN, n, i) for i, n in enumerate(lengths)], "what int, size long, id long")
    held = defaultdict(list)
    found = packing.packed_rows(state, capacity, range_rows).collect()
    for r in found:
        held[r.sequence_id].append((r.offset, lengths[r.row_]))
    assert sorted(r.row_ for r in found) == list(range(len(lengths)))
    for parts in held.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(held) <= best_fit_bins(lengths, capacity) * 1.005 + 1


def test_packing(docs, rows):
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    whole = tokenizers.Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    found = packing.best_fit(docs, files.path("byte_bpe_50k.json")).collect()
    want = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())))
    assert ordered(r[:5] for r in found) == ordered(want)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 1024
    assert len(held) <= best_fit_bins([w[3] for w in want], 1024) + 1
    assert packing.best_fit(docs.limit(0), files.path("byte_bpe_50k.json")).count() == 0


def test_ids_by_rank_equal_the_tokenizer(tmp_path, monkeypatch):
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    whole = tokenizers.Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    ids = packing.encoder(files.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    texts = ["", " ", "\n\n x", "don't WON'T I'll", "a b c\u0085d", "<|endoftext|> in text", "\U0001f600 mixed ́ é", "9" * 300, "é" * 90]
    texts += ["".join(chr(c) for c in rng.integers(1, 0x2FFF, 60)) for _ in range(100)]
    mixed = [*(chr(c) for c in range(1, 0x600)), *(" " * 900), *("\n\t\r\u00a0\u3000\u2028" * 40), *("aé9.,!'s" * 90)]
    texts += ["".join(rng.choice(mixed, 60)) for _ in range(1500)] + [" a", "a ", "a  b", "a   b", "a \nb", "a\n b", "a\n \nb", "a \n\n c", "b\n ", " ", "  ", "\n", "it 's  so"]
    texts += [" " * 60_000 + "a", "\n" * 3000, "x" * 30_000, "Здравствуй, мир", "価格は五百円です", "مرحبا بالعالم", "“quoted” – dash… €5", "a" + "\u0301" * 40]
    for t in texts:
        assert ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)[:200]
    assert packing.rank_encoder(files.path("byte_bpe_50k.json")) is not None
    # Another kind of tokenizer, and one whose merges are not in the order of its ids, are asked themselves.
    other = tokenizers.Tokenizer.from_file(files.path("word_bpe_49k.json"))
    assert packing.rank_encoder(files.path("word_bpe_49k.json")) is None
    assert packing.encoder.__wrapped__(files.path("word_bpe_49k.json"))("Some words, here.").tolist() == other.encode("Some words, here.", add_special_tokens=False).ids
    said = json.loads(open(files.path("byte_bpe_50k.json"), encoding="utf-8").read())
    said["model"]["merges"][:2] = said["model"]["merges"][1::-1]
    (tmp_path / "turned.json").write_text(json.dumps(said), encoding="utf-8")
    assert packing.rank_encoder(str(tmp_path / "turned.json")) is None
    # A difference that is met is an error.
    monkeypatch.setattr(packing, "PARTS", r"\S+|\s+")
    wrong = packing.encoder.__wrapped__(files.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="differ"):
        wrong("two words, one mark")


@pytest.mark.parametrize("hot", [warc.HOT_COPIES, 2])
def test_archive_round_trip(spark, rows, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_COPIES", hot)
    pages = spark.createDataFrame([(i, f"http://x/{i}\n", t, 1) for i, t in rows], "page_id long, url string, html string, record_type int")
    path = str(tmp_path / "warc")
    found = warc.round_trip(pages, path).collect()
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    want = []
    for t, ids in by.items():
        digest = base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        last = max((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=lambda i: (i != last, str(i)))
        want += [(i, len(t.encode()), digest, "revisit" if k else "response", last if k else None) for k, i in enumerate(ids)]
    assert ordered(found) == ordered(want)
    warc.write_index(spark, path)
    [(fields, payload)] = warc.lookup(spark, path, [310])
    assert payload.decode() == dict(rows)[310] and fields["WARC-Target-URI"] == "http://x/310%0A"
    assert len(warc.lookup(spark, path, [301, 7, None])) == 2 + 1 + 2 and warc.lookup(spark, path, [123456]) == []
    assert warc.read_back(spark, path).count() == len(rows)  # the index is no bundle
    assert warc.round_trip(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_files_hold_the_bundles_byte_by_byte(spark, tmp_path):
    """The text writer with a line separator of the seek table's end must add, drop and re-encode nothing."""
    path = str(tmp_path / "bytes")
    payload = bytes(range(256)).decode("latin-1") + "\r\n\x00é€\n" * 50
    warc.write(spark.createDataFrame([(k, "u", payload + str(k)) for k in range(40)], "page_id long, url string, html string"), path, bundle_bytes=4000)
    files = [bytes(r[0]) for r in spark.read.format("binaryFile").load(path).where("length > 0").select("content").collect()]
    assert len(files) > 3
    for content in files:
        held = warc.Bundle(content)
        records = [(i, warc.record(i, "u", (payload + str(i)).encode(), None)) for i, *_ in held.index]
        assert content == warc.bundle(records) + warc.TAIL


def test_bundles_are_plain_zstandard():
    import zstandard

    records = [(i, warc.record(i, "u", b"x" * i, None)) for i in range(2000)]
    content = warc.bundle(records, 4096) + warc.TAIL
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole == b"".join(r for _, r in records)
    held = warc.Bundle(content)
    assert len(held.starts) > 100 and held.find(1234)[0][1] == b"x" * 1234 and not held.find(5000)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy now, it is very cheap today, is it not?</div>
<article class="post"><h1>Head&#233;r</h1><p>One <b>two</b>&nbsp; three<br>four<p>Five &lt;six&gt;.
<div class="newsletter">Get our letter every day of the week</div><p>Seven.</p><section id="comments"><p>I was first to comment on this here</p></section></article>
<aside>Side note that is long enough to look like text</aside><footer>&copy; all</footer>"""


def test_main_text():
    tree = html.trained()
    assert html.main_text(PAGE, tree) == "Headér\nOne two three four\nFive <six>.\nSeven."
    assert html.main_text(None, tree) == html.main_text("", tree) == html.main_text("<p", tree) == ""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "<div>" * 3000 + "deep", "x"), (3, "w", "<p>" + "word " * 50000, "x")], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in html.extract(pages).collect()}
    assert found[1].n_chars == len(found[1].text) and found[2].text == "" and found[3].n_chars == 249999
    assert html.extract(pages.limit(0)).count() == 0


def test_patterns_do_not_blow_up():
    import time

    began = time.time()
    html.blocks("<a " + "x='" * 20000)
    html.blocks("<!--" * 20000)
    html.blocks("<script>" * 5000)
    assert time.time() - began < 10
    assert re.escape("a") == "a"
