import os
import time

from logweave.operators.formats import SourceSpec
from logweave.plans.engine import follow
from logweave.streaming import live
from logweave.streaming.tail import TailReader

T = "2026-06-01T12:00:0"


def test_reader_follows_appends_rotation_and_truncation(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"one\n\ntwo\r\nhal")
    r = TailReader(str(path), 1000)
    rows, at = r.read(r.initialOffset())
    assert list(rows) == [(0, "one"), (1, "two")]
    with path.open("ab") as f:
        f.write(b"f\nmore\n")
    rows, then = r.read(at)
    assert list(rows) == [(2, "half"), (3, "more")]
    assert list(r.readBetweenOffsets(at, then)) == [(2, "half"), (3, "more")]
    path.rename(tmp_path / "a.log.1")
    rows, same = r.read(then)
    assert list(rows) == [] and same == then
    path.write_bytes(b"new file\n")
    rows, then = r.read(then)
    assert list(rows) == [(4, "new file")]
    os.truncate(path, 0)
    with path.open("ab") as f:
        f.write(b"x\n")
    rows, then = r.read(then)
    assert list(rows) == [(5, "x")]


def test_batches_are_bounded(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"".join(b"line %d\n" % i for i in range(100)) + b"y" * 500 + b"\nend\n")
    r, at, seen, batches = TailReader(str(path), 64), {"inode": 0, "pos": 0, "seq": 0}, [], 0
    while True:
        rows, then = r.read(at)
        rows = list(rows)
        if then == at:
            break
        seen, at, batches = seen + rows, then, batches + 1
    assert [x for _, x in seen] == [f"line {i}" for i in range(100)] + ["y" * 500, "end"] and batches > 10
    assert [s for s, _ in seen] == list(range(102))
    assert TailReader(str(path), 64, from_end=True).initialOffset()["pos"] == path.stat().st_size


def test_follow(spark, tmp_path):
    path = tmp_path / "live.log"
    line = lambda i, level: f'{{"ts":"{T}{i}Z","level":"{level}"}}\n'
    path.write_text(line(0, "info") + line(1, "error"))
    query = live.append_records(follow(spark, str(path), query="NOT level=info"), f"{tmp_path}/out", f"{tmp_path}/cp", "100 milliseconds")
    try:
        deadline, got = time.time() + 60, []
        while time.time() < deadline and len(got) < 2:
            time.sleep(0.5)
            if path.exists() and query.lastProgress and path.read_text().count("\n") == 2:
                with path.open("a") as f:
                    f.write("not json\n" + line(2, "info"))
            try:
                got = sorted((r["line_id"], r["severity"], r["bad_line"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
            except Exception:
                got = []
        assert got == [(1, 5, False), (2, 0, True)]
        assert live.progress(query) >= 2
    finally:
        query.stop()


def test_live_histogram_and_fold(spark, tmp_path):
    path = tmp_path / "live.log"
    path.write_text("".join(f"ts={T}{i}Z level=info\n  at x\n" for i in range(4)))
    spec = SourceSpec("logfmt")
    counts = live.live_histogram(follow(spark, str(path), spec), "2 seconds")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("bins").start()
    try:
        q.processAllAvailable()
        assert sorted(r["count"] for r in spark.table("bins").collect()) == [2, 2]
    finally:
        q.stop()
    from pyspark.sql import functions as F

    lines = spark.readStream.format("logtail").option("path", str(path)).load().select(F.lit(0).alias("source_id"), "seq", "raw")
    q = live.fold_stream(lines, spec, 500).writeStream.outputMode("append").format("memory").queryName("folded").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("folded").count() < 4:
            with path.open("a") as f:
                pass
            time.sleep(0.5)
        assert sorted((r["seq"], r["raw"]) for r in spark.table("folded").collect()) == [(2 * i, f"ts={T}{i}Z level=info\n  at x") for i in range(4)]
    finally:
        q.stop()
