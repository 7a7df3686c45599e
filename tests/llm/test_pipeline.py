"""The pipeline's stages against plain versions, and all queries against their SQL twins."""

import glob
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomline.llm import decontam, jaccard, licenses, packing, quality, queries, sharding, substrings, suffixes

from .conftest import ordered
from .test_joins_and_files import plain_components
from .test_words_and_bytes import plain_hits, plain_repeats

DATA = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.written(stage("quality rules")(spark, docs, DATA), "t")
    verdict = {r.doc_id: r.kept for r in queries.queries()["op1_quality_rules"](spark, DATA).collect()}
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in verdict.items() if k)

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = corpus_pipeline.written(stage("n-gram Jaccard join")(spark, kept, DATA), "t")
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in plain_components(rows, 5, 80)})

    rows = [(r.doc_id, r.text) for r in one.collect()]
    cut = corpus_pipeline.written(stage("substring dedup")(spark, one, DATA), "t")
    seqs, gone = plain_repeats(rows, 35, lambda t: (t or "").encode().split())
    want = [(i, t if not g else b" ".join(w for k, w in enumerate(u) if k not in g).decode()) for (i, t), u, g in zip(rows, seqs, gone)]
    assert cut.columns == columns and ordered((r.doc_id, r.text) for r in cut.collect()) == ordered(want)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = corpus_pipeline.written(stage("benchmark decontamination")(spark, cut, DATA), "t")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in plain_hits(want, items) if not r[5])

    check_pieces(stage("best-fit packing")(spark, clean, DATA), [(r.doc_id, r.text) for r in clean.collect()])


def check_pieces(pieces, rows):
    """Every document's ids lie in its pieces, whole and in order, and sequences are gapless and within their capacity."""
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    whole = tokenizers.Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 1024))]
    found = pieces.collect()
    assert ordered(r[:5] for r in found) == ordered(want)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))]).tolist()
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


def trouble(spark, sf_dir, docs, items):
    """A folder of tables for a run."""
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    items.write.parquet(f"{sf_dir}/benchmark.parquet")
    return str(sf_dir)


def test_run_on_empty_tables(spark, docs, tmp_path):
    items = spark.createDataFrame([], "item_id long, text string")
    sf_dir = trouble(spark, tmp_path, docs.limit(0), items)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
    none = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, call in corpus_pipeline.STAGES:
        found = call(spark, none, sf_dir)
        assert found.count() == 0, name
        assert name == "best-fit packing" or found.columns == none.columns, name


def test_run_on_rows_with_trouble(spark, docs, rows, tmp_path):
    """Null, empty and long texts, null ids, repeated rows, clashing names: each stage keeps what it must, and the run ends in
    gapless sequences of whole documents."""
    texts = dict(rows)
    items = spark.createDataFrame([(1, " ".join(texts[3].split()[:14])), (None, None), (2, "")], "item_id long, text string")
    sf_dir = trouble(spark, tmp_path, docs, items)
    for name, call in corpus_pipeline.STAGES[:-1]:  # each stage on all rows, nulls and empty texts among them
        found = call(spark, docs, sf_dir)
        assert found.columns == docs.columns and found.dtypes == docs.dtypes, name
        ids = {r.doc_id for r in found.collect()}
        if name != "quality rules":
            assert {303, 304, 306} <= ids, name
    pieces = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in pieces.collect()}
    assert {0, 1, 310} <= ids and not ids & {3, 303, 304, 306, 309}


def test_very_long_texts(spark):
    """A text of 60,000 words with a passage of its own twice, beside short rows, through every operator on documents."""
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 60_000)]
    words[50_000:50_100] = words[1_000:1_100]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3])), (3, "short text of a few words that nothing else has in it"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert [r.n_words for r in quality.quality_cascade(docs).orderBy("doc_id").collect()][:2] == [60_000, 59_997]
    assert sum(r.size for r in sharding.kd_shards(docs, 3).collect()) == sum(len(t or "") + 8 for _, t in rows)
    assert {r.doc_id: r.n_removed for r in substrings.word_repeats(docs).collect()} == {1: 59_997, 2: 59_997, 3: 0, 4: 0}
    assert {r.doc_id: r.n_removed for r in substrings.word_repeats(docs.where("doc_id <> 2")).collect()}[1] == 200
    same = next(r for r in suffixes.byte_repeats(docs.where("doc_id <> 2")).collect() if r.doc_id == 1)
    assert same.n_spans == 1 and len(" ".join(words[1_000:1_100])) <= same.n_removed <= len(" ".join(words[1_000:1_100])) + 6
    items = spark.createDataFrame([(7, " ".join(words[55_000:55_010]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.decontaminate(docs, items).collect()} == {1: 10, 2: 10, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in jaccard.component_ids(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    noticed = spark.createDataFrame([(1, " ".join([*words[:30_000], "Released under the MIT License", *words[30_000:]]))], "doc_id long, text string")
    assert licenses.license_scan(noticed).first().labels == "mit"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert ordered(found.select(*columns).collect()) == ordered(want.fetchall())
