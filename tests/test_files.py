"""Sources, sinks and streams on small files with planted defects."""

import io
import json
import os
import tarfile
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from loomline.sinks import files as sinks
from loomline.sources import config, files
from loomline.streaming import logs


def test_env_file(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# note\nA=1\nexport B = 'two words'\nC=\"x=y\"\nD=kept\nno equals\n\n")
    environ = {"D": "set before"}
    assert config.load_env(path, environ) == {"A": "1", "B": "two words", "C": "x=y"} and environ["D"] == "set before"
    assert config.load_env(tmp_path / "none", environ) == {}


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text('[paths]\ndata_root = "data"\nraw = "raw/x"\n[prepare]\nseed = 1\n')
    c = config.Config.load("c.toml", tmp_path)
    assert c.path("raw") == tmp_path / "data" / "raw/x" and c["prepare"]["seed"] == 1
    monkeypatch.setenv("LOOMLINE_DATA", "/elsewhere")
    assert str(config.Config.load("c.toml", tmp_path).path("raw")) == "/elsewhere/raw/x"
    assert config.single_rate([44100, None, 44100]) == 44100
    for bad in ([], [1, 2]):
        with pytest.raises(ValueError):
            config.single_rate(bad)
    config.check_ratios({"a": 0.8, "b": 0.1, "c": 0.1})
    with pytest.raises(ValueError):
        config.check_ratios({"a": 0.8})


def test_discovery(spark, tmp_path):
    for name in ("ex01/sad/base/ex01_sad_00001.wav", "ex01/sad/base/ex01_sad_emph_2.wav", "ex01/sad/base/ex02_sad_3.wav", "ex01/sad/ex01_sad_4.wav", "ex01/sad/base/._ex01_sad_00001.wav", "ex01/sad/base/note.txt"):
        target = tmp_path / "read" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x")
    found = files.binary_files(spark, str(tmp_path / "read")).select("path")
    clips, problems = files.discovered(found, "read")
    assert sorted((r.stem, r.substyle) for r in clips.collect()) == [("ex01_sad_00001", None), ("ex01_sad_emph_2", "emph"), ("ex02_sad_3", None)]
    assert sorted((r.file, r.problem) for r in problems.collect()) == [("ex01/sad/base/ex02_sad_3.wav", "name disagrees with folders"), ("ex01/sad/ex01_sad_4.wav", "unexpected depth")]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\tone\tmore\n\nno tab\nb\t two \n a \tagain\n\tno stem\n", encoding="utf-8")
    texts, problems = files.transcripts(files.numbered_lines(spark, str(tmp_path / "t.txt")))
    assert {r.stem: r.text for r in texts.collect()} == {"a": "one\tmore", "b": "two"}
    assert sorted((r.line, r.problem) for r in problems.collect()) == [(3, "no tab separator"), (5, "duplicate transcript for a"), (6, "no tab separator")]


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "train.txt").write_text("# head\nex01_sad_1\t0.5\na-b_sad_2\nex01_sad_1\n")
    assert [r.stem for r in files.split_list(files.numbered_lines(spark, str(tmp_path / "train.txt"))).collect()] == ["ex01_sad_1"]
    (tmp_path / "log").write_text("x\nEval results for step (37 / 370 | Eval Loss: 4.25 |\nEval results for step (37 / 370 | Eval Loss: 4.5 |\n")
    assert [(r.step, r.loss, r.line) for r in files.eval_losses(files.numbered_lines(spark, str(tmp_path / "log"))).orderBy("line").collect()] == [(37, 4.25, 2), (37, 4.5, 3)]


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "é"}\n\n{"a": 2}\n', encoding="utf-8")
    assert [tuple(r) for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "a long, b string").orderBy("a").collect()] == [(1, "é"), (2, None)]
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.jsonl(spark, str(tmp_path / "bad.jsonl"), "a long").collect()
    (tmp_path / "r.json").write_text(json.dumps({"ratings": {"x": {"emotion": "sad", "naturalness": "4"}, "y": {"emotion": ""}}}, indent=1))
    from loomline.operators.evaluation import ratings_rows

    doc = files.json_document(spark, str(tmp_path / "r.json"), "ratings map<string,struct<emotion:string,naturalness:string>>")
    assert sorted((r.label, r.answer.emotion) for r in ratings_rows(doc).collect()) == [("x", "sad"), ("y", "")]


def make_tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))


def test_tar(spark, tmp_path):
    make_tar(tmp_path / "a.tar", {"x/1.wav": b"one", "x/2.txt": b"two", "x/3.wav": b"three"})
    assert files.extract_tar(tmp_path / "a.tar", tmp_path / "out", ["*.wav"]) == {"extracted": 2, "present": 0, "skipped": 1}
    assert files.extract_tar(tmp_path / "a.tar", tmp_path / "out", ["*.wav"])["present"] == 2
    make_tar(tmp_path / "bad.tar", {"../evil.wav": b"x"})
    with pytest.raises(ValueError, match="unsafe"):
        files.extract_tar(tmp_path / "bad.tar", tmp_path / "out", ["*"])


class Flaky(BaseHTTPRequestHandler):
    body, drops = bytes(range(256)) * 40, 2

    def do_HEAD(self):
        self.answer(200, self.body, False)

    def do_GET(self):
        start = int(self.headers["Range"].split("=")[1].rstrip("-")) if "Range" in self.headers else 0
        part = self.body[start:]
        if Flaky.drops:
            Flaky.drops -= 1
            self.answer(206 if start else 200, part, True, len(part) // 2)
            self.close_connection = True
        else:
            self.answer(206 if start else 200, part, True)

    def answer(self, code, part, send, cut=None):
        self.send_response(code)
        self.send_header("Content-Length", str(len(part)))
        self.send_header("ETag", '"1"')
        self.end_headers()
        if send:
            self.wfile.write(part[:cut])

    def log_message(self, *_):
        pass


def test_download_resumes(tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Flaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/f"
    head = files.remote_head(url)
    assert head["size"] == len(Flaky.body) and head["etag"] == '"1"'

    def patient(get):
        try:
            return get()
        except Exception as e:  # a cut-off body may surface as IncompleteRead
            if "IncompleteRead" not in type(e).__name__:
                raise
            return None

    get = partial(files.download, url, tmp_path / "f.part", head["size"], head["etag"], wait=lambda s: None)
    for _ in range(4):
        patient(get)
    assert (tmp_path / "f.part").read_bytes() == Flaky.body
    server.shutdown()


def test_sinks(spark, tmp_path):
    sinks.write_json(tmp_path / "d" / "x.json", {"é": 1})
    assert json.loads((tmp_path / "d" / "x.json").read_text(encoding="utf-8")) == {"é": 1} and os.listdir(tmp_path / "d") == ["x.json"]
    df = spark.createDataFrame([("b", None), ("a", "é"), ("c", "x")], "id string, t string")
    sinks.write_jsonl(df, str(tmp_path / "rows"), ["id"])
    lines = [line for f in sorted((tmp_path / "rows").glob("part-*")) for line in f.read_text(encoding="utf-8").splitlines()]
    assert lines == ['{"id":"a","t":"é"}', '{"id":"b","t":null}', '{"id":"c","t":"x"}']
    assert sinks.append_new(df, str(tmp_path / "log"), "id") == 3
    assert sinks.append_new(df.union(spark.createDataFrame([("d", "new")], df.schema)), str(tmp_path / "log"), "id") == 1
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    text = sinks.report("T", [("S", df.orderBy("id").select("id", F.lit(0.256).alias("x")))], {"x": ".0%"})
    assert "| a | 26% |" in text and "## S" in text
    with pytest.raises(ValueError):
        sinks.report("T", [("S", spark.range(50))], most=10)
    assert sinks.leaking_words("page-SAD-1", ["sad", "default"]) == ["sad"]
    record = sinks.provenance(tmp_path / "p.json", "somewhere", [tmp_path / "d" / "x.json"])
    assert list(record["files"].values())[0]["bytes"] > 0


def test_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    row = lambda i, run: json.dumps({"clip_id": f"c{i}", "run": run, "style": "sad", "text": "t", "created_at": f"2024-01-01T00:{i:02d}:00Z", "duration_s": 1.5, "wav": "w"})
    (log / "1.jsonl").write_text("\n".join([row(1, "a"), row(2, "a"), row(1, "a")]) + "\n")
    args = (str(tmp_path / "table"), str(tmp_path / "check"))
    logs.follow(logs.clip_stream(spark, str(log)), *args).awaitTermination(60)
    (log / "2.jsonl").write_text("\n".join([row(2, "a"), row(3, "b")]) + "\n")
    logs.follow(logs.clip_stream(spark, str(log)), *args).awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(r.clip_id for r in found.collect()) == ["c1", "c2", "c3"]
    totals = {r.run: (r.clips, r.seconds) for r in logs.run_totals(found).collect()}
    assert totals == {"a": (2, 3.0), "b": (1, 1.5)}


def test_a_large_folder_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Above the driver's bound the same files, of the same times and contents, as Spark's own listing finds: not hidden or empty ones."""
    root = tmp_path / "a b%20c"
    for name, content in (("x.wav", b"one"), ("sub/y.wav", b"two"), ("sub/deep/z.wav", b"three" * 9), ("sub/k=1/n.wav", b"4"), ("sub/empty.wav", b""), ("_no/v.wav", b"n"), ("sub/.h/v.wav", b"n"), ("._x.wav", b"n"), ("x.txt", b"n")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    columns = ["path", "modificationTime", "length", "content"]
    own = sorted(files.binary_files(spark, str(root)).select(columns).collect())
    assert len(own) == 4
    monkeypatch.setattr(files, "DRIVER_LISTS", 3)
    monkeypatch.setattr(files, "BATCH_BYTES", 4)
    monkeypatch.setattr(files, "large_folder", lambda *a, f=files.large_folder: f(*a) or pytest.fail("taken for a small one"))
    assert sorted(files.binary_files(spark, str(root)).select(columns).collect()) == own
    assert sorted(files.listed_files(spark, f"file:{root}").collect()) == [r[:3] for r in own]
    assert files.listed_files(spark, str(root), "?.none").count() == 0
