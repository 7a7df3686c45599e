"""Split tar scans, committed files, resumed logs and followed logs, with planted failures."""

import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from loomline.sinks import committed
from loomline.sinks.resume import ClipLog
from loomline.sources import archives
from loomline.streaming import logs, tail

from .test_files import make_tar


def big_tar(path, count=300):
    contents = {f"d{i % 7}/{'long' * 40 if i % 50 == 0 else 'n'}{i}.wav": bytes([i % 251]) * (i * 37 % 4000) for i in range(count)}
    make_tar(path, contents | {"notes.txt": b"x"})
    return contents


def test_index_and_contents(spark, tmp_path):
    contents = big_tar(tmp_path / "a.tar")
    path = str(tmp_path / "a.tar")
    index = archives.tar_index(spark, [path], ["*.wav"])
    rows = index.collect()
    raw = (tmp_path / "a.tar").read_bytes()
    assert {r.name: raw[r.at : r.at + r.size] for r in rows} == contents and len(rows) == 300
    found = archives.tar_contents(index, 1 << 14)
    assert {r.name: bytes(r.content) for r in found.collect()} == contents
    some = archives.tar_contents(index.where("name like 'd3/%'"), 1 << 14).collect()
    assert {r.name for r in some} == {n for n in contents if n.startswith("d3/")}
    there = spark.createDataFrame([(n, len(c)) for n, c in list(contents.items())[:290]], "name string, size long")
    assert archives.lacking_files(index, there).count() == 10


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    contents = big_tar(tmp_path / "a.tar")
    spark.dataSource.register(archives.TarSource)
    rows = spark.read.format("loomline_tar").option("patterns", "*.wav").option("run_bytes", 1 << 15).load(str(tmp_path / "a.tar"))
    tasks = rows.select("name", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.name for r in tasks) == sorted(contents) and len({r.task for r in tasks}) > 10
    assert {r.name: bytes(r.content) for r in rows.collect()} == contents
    for size in (1, 700, 1 << 30):
        stretches = archives.runs(str(tmp_path / "a.tar"), size)
        assert stretches[0][0] == 0 and all(a[1] == b[0] for a, b in zip(stretches, stretches[1:])) and stretches[-1][1] == os.path.getsize(tmp_path / "a.tar")


def test_broken_archives(spark, tmp_path):
    contents = big_tar(tmp_path / "a.tar", 60)
    raw = (tmp_path / "a.tar").read_bytes()
    with tarfile.open(tmp_path / "a.tar") as tar:
        at = [m.offset for m in tar][30]
    for name, broken in {"cut": raw[: at - 100], "header": raw[:at] + b"\xff" * 512 + raw[at + 512 :], "not": b"no archive" * 200}.items():
        (tmp_path / f"{name}.tar").write_bytes(broken)
        with pytest.raises(tarfile.ReadError):
            list(archives.jumped(str(tmp_path / f"{name}.tar")))
        with pytest.raises(Exception, match="ReadError"):
            archives.tar_index(spark, [str(tmp_path / f"{name}.tar")]).collect()
    make_tar(tmp_path / "evil.tar", {"ok.wav": b"x", "../evil.wav": b"x"})
    with pytest.raises(Exception, match="unsafe"):
        archives.tar_index(spark, [str(tmp_path / "evil.tar")]).collect()
    with tarfile.open(tmp_path / "z.tar.gz", "w:gz") as tar:
        tar.addfile(tarfile.TarInfo("a"), io.BytesIO(b""))
    with pytest.raises(tarfile.ReadError):
        list(archives.jumped(str(tmp_path / "z.tar.gz")))
    make_tar(tmp_path / "empty.tar", {})
    assert list(archives.jumped(str(tmp_path / "empty.tar"))) == [] and len(contents) == 60


def files_below(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def test_files_come_all_or_not_at_all(spark, tmp_path):
    df = spark.range(50).select(F.concat(F.lit("q"), F.col("id") % 3, F.lit("/"), "id", F.lit(".bin")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    target = tmp_path / "out"
    committed.write_files(df.repartition(4), str(target))
    assert files_below(target) == {f"q{i % 3}/{i}.bin": str(i).encode() for i in range(50)}
    assert os.listdir(tmp_path) == ["out"]

    @F.udf("binary")
    def fails(i):
        if i == 40:
            raise OSError("killed")
        return b"new"

    bad = spark.range(50).repartition(4).select(F.concat(F.lit("late/"), "id").alias("name"), fails("id").alias("content"))
    with pytest.raises(Exception, match="killed"):
        committed.write_files(bad, str(target))
    assert len(files_below(target)) == 50 and os.listdir(tmp_path) == ["out"]
    for wrong, why in (([("a", b"1"), ("a", b"2")], "2 rows are named"), ([("../x", b"1")], "unsafe"), ([("/x", b"1")], "unsafe")):
        with pytest.raises(Exception, match=why):
            committed.write_files(spark.createDataFrame([(n, bytearray(c)) for n, c in wrong], "name string, content binary"), str(target))
    with pytest.raises(Exception, match="there already"):
        committed.write_files(df.limit(1), str(target), replace=False)
    assert len(files_below(target)) == 50 and os.listdir(tmp_path) == ["out"]
    committed.write_files(df.limit(0), str(target))
    with pytest.raises(ValueError, match="mounted"):
        committed.mounted("s3://bucket/x")
    assert str(committed.mounted("file:///a/b")) == str(committed.mounted("file:/a/b")) == "/a/b"


def test_a_second_copy_of_a_task_writes_nothing_twice(tmp_path):
    """Two attempts of one task: only the one that the driver hears of is moved."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": [b"1", None]})
    writer = committed.FileWriter(str(tmp_path / "out"), False)
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.files != second.files
    writer.commit([second, None])
    assert files_below(tmp_path / "out") == {"a": b"1", "b": b""} and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileNotFoundError):
        writer.write(iter([batch]))  # a task that outlives its job
    late = committed.FileWriter(str(tmp_path / "out"), True)
    late.write(iter([batch]))
    late.abort([None])
    assert os.listdir(tmp_path) == ["out"]


def test_resumed_log(spark, tmp_path, monkeypatch):
    log = ClipLog(spark, str(tmp_path / "log"), str(tmp_path / "files"), "clip_id string, file string, n int")
    work = lambda *ids: spark.createDataFrame([(f"c{i}", f"sub/{i}.wav", i) for i in ids], "clip_id string, file string, n int")

    def make(df):
        committed.write_files(df.select(F.col("file").alias("name"), F.col("clip_id").cast("binary").alias("content")), str(tmp_path / "files"))
        return df

    assert log.pending(work(1, 2, 2)).count() == 2
    assert log.append(work(1, 2, 2), 0, make) == 2
    assert log.append(work(1, 2, 3), 0, make) == 0  # replayed
    assert log.append(work(1, 2, 3), 1, make) == 1
    os.remove(tmp_path / "files" / "sub" / "1.wav")
    assert [r.clip_id for r in log.pending(work(1, 2, 3)).collect()] == ["c1"]
    assert log.append(work(1, 2, 3), 2, make) == 1
    assert sorted((r.clip_id, r.batch) for r in log.rows().collect()) == [("c1", 2), ("c2", 0), ("c3", 1)]
    # A batch that dies before it is in the ledger doesn't count, and is written over.
    died = f"{log.folder}/batches/batch=3"
    work(7).write.json(died)
    assert log.rows().count() == 3 and log.pending(work(7)).count() == 1
    assert log.append(work(7, 8), 3, make) == 2 and log.append(work(7, 8), 3, make) == 0
    assert log.rows().count() == 5


def test_followed_work_is_logged_once(spark, tmp_path):
    log = ClipLog(spark, str(tmp_path / "log"), str(tmp_path / "files"), "clip_id string, file string")
    (tmp_path / "in").mkdir()
    (tmp_path / "files").mkdir()
    for n, ids in enumerate((["a", "b"], ["b", "c"])):
        (tmp_path / "in" / f"{n}.json").write_text("".join(f'{{"clip_id": "{i}", "file": "{i}.wav"}}\n' for i in ids))
        for i in ids:
            (tmp_path / "files" / f"{i}.wav").write_bytes(b"x")
        for state in ("state", "state"):
            log.follow(spark.readStream.schema(log.schema).json(str(tmp_path / "in")), str(tmp_path / state)).awaitTermination()
    assert sorted((r.clip_id, r.batch) for r in log.rows().collect()) == [("a", 0), ("b", 0), ("c", 1)]
    log.follow(spark.readStream.schema(log.schema).json(str(tmp_path / "in")), str(tmp_path / "lost state")).awaitTermination()
    assert log.rows().count() == 3


def test_followed_lines(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    log = tmp_path / "logs"
    log.mkdir()

    def poll():
        lines = spark.readStream.format("loomline_tail").option("part_bytes", 40).load(str(log / "*.log"))
        logs.follow(lines, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
        return sorted(r.line for r in spark.read.parquet(str(tmp_path / "table")).collect())

    first = [f"line {i} é {'x' * (i % 23)}" for i in range(30)]
    (log / "a.log").write_text("\n".join(first) + "\nhalf", encoding="utf-8")
    assert poll() == sorted(first)
    assert poll() == sorted(first)  # nothing new
    with open(log / "a.log", "a") as f:
        f.write(" done\r\nnext\n")
    (log / "b.log").write_text("other\n\n")
    (log / "c.log").write_text("no end yet")
    second = [*first, "half done", "next", "other", ""]
    assert poll() == sorted(second)
    (log / "a.log").write_text("cut\n")  # shorter, and begins otherwise
    with open(log / "b.log", "a") as f:
        f.write("more\n")
    assert poll() == sorted([*second, "cut", "more"])
    os.remove(log / "b.log")
    (log / "a.log").write_text("regrown beyond\n" + "y" * 2000 + "\n")
    assert poll() == sorted([*second, "cut", "more", "regrown beyond", "y" * 2000])


def test_offsets(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"a" * 200_000 + b"\n" + b"b" * 150_000)
    offset = tail.offset_of(str(path))
    assert offset[0] == 200_001 and tail.offset_of(str(tmp_path / "none")) is None
    path.write_bytes(b"b" * 150_000)
    assert tail.offset_of(str(path)) is None
    assert tail.new_bytes([10, 1, 2], [20, 1, 2]) == (10, 20) and tail.new_bytes([10, 1, 2], [20, 1, 3]) == (0, 20)
    assert tail.new_bytes([10, 1, 2], [5, 1, 2]) == (0, 5) and tail.new_bytes(None, [5, 1, 2]) == (0, 5)


def test_the_source_reads_members_in_bounded_batches(tmp_path, monkeypatch):
    """However many members a stretch has, few megabytes of them leave at once."""
    monkeypatch.setattr(archives, "BATCH_BYTES", 1000)
    path = tmp_path / "many.tar"
    with tarfile.open(path, "w") as tar:
        for i in range(50):
            info = tarfile.TarInfo(f"{i}.txt")
            info.size = 300
            tar.addfile(info, io.BytesIO(bytes([i]) * 300))
    reader = archives.TarReader({"path": str(path)})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) > 10 and all(sum(map(len, b.column(3).to_pylist())) <= 1300 for b in batches)
    assert [(n, c) for b in batches for n, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist())] == [(f"{i}.txt", bytes([i]) * 300) for i in range(50)]


def test_many_archives_are_few_partitions(spark, tmp_path, monkeypatch):
    """Small archives share partitions and are not opened for their headers; a large one among them is still cut."""
    import pickle

    contents, paths = {}, []
    for i in range(40):
        made = {f"{i}/{k}.txt": bytes([i, k]) * 300 for k in range(40 if i == 7 else 3)}
        make_tar(tmp_path / f"{i:02}.tar", made)
        contents |= made
        paths.append(str(tmp_path / f"{i:02}.tar"))
    monkeypatch.setattr(archives, "PARTITIONS", 10)
    cut, runs = [], archives.runs
    monkeypatch.setattr(archives, "runs", lambda path, size: cut.append(path) or runs(path, size))
    reader = archives.TarReader({"path": ",".join(paths), "run_bytes": "512"})
    parts = reader.partitions()
    assert 8 <= len(parts) <= 11 and set(cut) <= {paths[7]} and len({p for part in parts for p, _, _ in part.value}) == 40
    sent = pickle.loads(pickle.dumps(reader))
    assert not sent.paths
    rows = [(n, c) for p in parts for b in sent.read(p) for n, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
    assert dict(rows) == contents and len(rows) == len(contents)
    spark.dataSource.register(archives.TarSource)
    found = spark.read.format("loomline_tar").option("run_bytes", 512).load(",".join(paths))
    assert {r.name: bytes(r.content) for r in found.collect()} == contents


def test_the_driver_holds_no_names_of_files(tmp_path, monkeypatch):
    """What a task says of its files does not grow with them, and names that repeat are found over several files of digests."""
    import pickle

    import pyarrow as pa

    monkeypatch.setattr(committed, "COMPARED", 40)
    monkeypatch.setattr(committed, "HELD", 7)
    names = [f"d{i % 3}/é\n{i}" for i in range(1500)]
    batch = lambda n: pa.RecordBatch.from_pydict({"name": n, "content": [x.encode() for x in n]})
    writer = committed.FileWriter(str(tmp_path / "out"), False)
    told = [writer.write(iter([batch(names[:1200])])), writer.write(iter([batch(names[1200:])]))]
    assert max(len(pickle.dumps(t)) for t in told) < 600
    writer.commit(told)
    assert files_below(tmp_path / "out") == {n: n.encode() for n in names} and os.listdir(tmp_path) == ["out"]
    again = committed.FileWriter(str(tmp_path / "new"), True)
    with pytest.raises(ValueError, match="3 rows are named 'twice'"):
        again.commit([again.write(iter([batch([*names, "twice"])])), again.write(iter([batch(["twice", "once", "twice"])]))])
    assert not os.path.exists(tmp_path / "new") and os.listdir(tmp_path) == ["out"]
