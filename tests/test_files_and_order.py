import gzip
import heapq
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import order
from logweave.operators.formats import SourceSpec
from logweave.plans.engine import LogEngine
from logweave.plans.view import ViewSpec
from logweave.sources import files, sinks

NDJSON = [f'{{"ts":"2026-06-01T12:00:0{i}Z","level":"{v}","logger":"app","msg":"{m}"}}' for i, (v, m) in enumerate([("info", "start"), ("warn", "slow"), ("error", "boom"), ("info", "done")])]
FIXTURES = {
    "structured.ndjson": NDJSON,
    "ecs.ndjson": ['{"@timestamp":"2026-06-01T12:00:00Z","severity_text":"info","msg":"ecs start","host":"web1"}', '{"@timestamp":"2026-06-01T12:00:01Z","severity_text":"error","msg":"ecs boom","host":"web1"}'],
    "plain.log": ["[INFO] Server started on port 8080", "[DEBUG] Connecting to postgres", "[ERROR] DB timeout", "[WARN] Queue depth above watermark", "[INFO] Health check OK"],
    "mixed.ndjson": [*(f'{{"ts":"2026-06-01T12:00:0{i}Z","level":"info","msg":"timed {i}"}}' for i in range(3)), "not json at all", "also not json", '{"ts":"2026-06-01T12:00:03Z","level":"warn","msg":"timed 4"}'],
    "logfmt.log": ['ts=2026-06-01T12:00:00Z level=info logger=app msg="server started"', 'ts=2026-06-01T12:00:01Z level=warn logger=db msg="slow query" duration=412ms', 'ts=2026-06-01T12:00:02Z level=error logger=app msg="db timeout" duration=5s', 'ts=2026-06-01T12:00:03Z level=info logger=app msg="health ok"', 'ts=2026-06-01T12:00:04Z level=error logger=auth msg="login failed" user=alice'],
    "clojure.edn": ['{:ts "2026-06-01T12:00:00Z" :level :info :logger "app" :msg "server started"}', '{:ts "2026-06-01T12:00:01Z" :level :warn :logger "db" :msg "slow query"}', '{:ts #inst "2026-06-01T12:00:02Z" :level :error :logger "app" :msg "boom"}', '{:event/type :http/request :ts "2026-06-01T12:00:03Z" :level :info :path "/api"}'],
    "data.csv": ["ts,level,host,msg", "2026-06-01T12:00:00Z,info,host01,server started", '2026-06-01T12:00:01Z,error,host02,"timeout, retry"', "2026-06-01T12:00:02Z,warn,host01,slow query"],
    "mostly-plain.log": ["just a line", "another line", '{"this":"looks like json but is alone"}', "plain again", "more plain", "even more plain", "final plain"],
}


@pytest.fixture
def put(tmp_path):
    def write(name, data=None):
        data = "".join(x + "\n" for x in FIXTURES[name]).encode() if data is None else data
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    return write


@pytest.mark.parametrize(
    "name,options,parts",
    [
        ("structured.ndjson", {}, ["indexed 4 records — untimed: 0 ", "json errors: 0", 'auto-columns: ["logger", "msg"]']),
        ("ecs.ndjson", {}, ["indexed 2 records — untimed: 2 "]), ("ecs.ndjson", {"time_field": "@timestamp", "level_field": "severity_text"}, ["indexed 2 records — untimed: 0 "]),
        ("plain.log", {}, ["indexed 5 records", "json errors: 5", "auto-columns: []"]), ("mixed.ndjson", {}, ["indexed 6 records — untimed: 2 ", "json errors: 2", '"msg"']),
        ("logfmt.log", {}, ["indexed 5 records — untimed: 0 ", "auto-columns: []"]), ("logfmt.log", {"format": "logfmt"}, ["indexed 5 records — untimed: 0 "]),
        ("clojure.edn", {}, ["indexed 4 records — untimed: 0 ", "json errors: 0"]), ("data.csv", {}, ["indexed 4 records — untimed: 1 "]), ("mostly-plain.log", {}, ["indexed 7 records — untimed: 7 "]),
    ],
)
def test_golden_summaries(spark, put, name, options, parts):
    text = LogEngine.open(spark, put(name), **options).summary()
    assert all(p in text for p in parts), text


def test_modes_and_errors(spark, put):
    assert LogEngine.open(spark, put("plain.log")).less_mode() and not LogEngine.open(spark, put("structured.ndjson")).less_mode()
    e = LogEngine.open(spark, put("data.csv"))
    assert [r["line_id"] for r in e.scan("host=host01 AND NOT level=warn").collect()] == [1] and e.records.where("is_header").count() == 1
    assert LogEngine.open(spark, put("data.csv")).scan('_4="timeout, retry"').count() == 1
    assert e.auto_columns(1) == [] and LogEngine.open(spark, put("structured.ndjson")).auto_columns(1) == ["logger"]
    with pytest.raises(ValueError, match="unknown --format"):
        LogEngine.open(spark, put("data.csv"), format="protobuf")
    with pytest.raises(ValueError, match="combined"):
        LogEngine.open(spark, ["-", put("data.csv")])
    with pytest.raises(ValueError, match="pattern"):
        LogEngine.open(spark, put("data.csv"), format="regex")


def test_compressed(spark, put):
    import zstandard

    text = "".join(x + "\n" for x in NDJSON).encode()
    for name, data in {"a.ndjson.gz": gzip.compress(text), "b.log": gzip.compress(text[:100]) + gzip.compress(text[100:]), "c.bin": zstandard.compress(text), "d.zst": zstandard.compress(text)}.items():
        e = LogEngine.open(spark, put(name, data))
        assert [r["raw"] for r in e.records.orderBy("line_id").collect()] == NDJSON, name
        assert e.records.where("ts_micros is not null").count() == 4


def test_arrays(spark, put):
    e = LogEngine.open(spark, put("a.json", b' [ {"b":1,"a":"x"}, "junk", 42, {"level":"error"} ] '))
    assert [r["raw"] for r in e.records.orderBy("line_id").collect()] == ['{"a":"x","b":1}', '{"level":"error"}']
    assert LogEngine.open(spark, put("b.json", b"[]")).records.count() == 0
    with pytest.raises(Exception, match="parse error"):
        LogEngine.open(spark, put("c.json", b"[{,}]")).records.count()
    with pytest.raises(ValueError, match="over 0 MB"):
        files.array_lines(spark, put("d.json", b"[{}]"), limit=2)


def test_lines(spark, put):
    path = put("x.log", b"alpha\n\nbeta\r\n\r\ngamma")
    rows = lambda d: [(r["seq"], r["raw"]) for r in d.orderBy("seq").collect()]
    assert rows(files.text_lines(spark, path)) == [(0, "alpha"), (1, "beta"), (2, "gamma")]
    assert rows(files.text_lines(spark, path, keep_cr=True)) == [(0, "alpha"), (1, "beta\r"), (2, "\r"), (3, "gamma")]
    assert rows(files.given_lines(spark, ["alpha\n", "\n", "beta\r\n"])) == [(0, "alpha"), (1, "beta")]
    assert LogEngine.open(spark, put("empty.log", b"")).records.count() == 0


@pytest.mark.parametrize("broadcast", [order.BROADCAST_SPLITS, 3])
def test_numbers_run_through_splits(spark, put, monkeypatch, broadcast):
    monkeypatch.setattr(order, "BROADCAST_SPLITS", broadcast)
    path = put("big.log", "".join(f"line {i} {'x' * (i % 97)}\n" for i in range(20_000)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = files.text_lines(spark, path).select("seq", F.regexp_extract("raw", r"line (\d+)", 1).cast("long").alias("n"))
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().sparkPlan().toString()) == (broadcast > 3)
        assert got.where("seq <> n").count() == 0 and got.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_save(spark, put, tmp_path):
    e = LogEngine.of_lines(spark, ["alpha", "beta", "gamma"])
    e.save(ViewSpec(regex="alpha|gamma"), f"{tmp_path}/out", single=True)
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "alpha\ngamma\n"
    with pytest.raises(ValueError):
        e.save(ViewSpec(), " ")


def test_bookmarks(tmp_path):
    b = sinks.Bookmarks(tmp_path / "x/marks.json")
    b.keep("/a", 1, 100, [[3, 1], []], "2026")
    b.save()
    b = sinks.Bookmarks(tmp_path / "x/marks.json")
    assert b.restore("/a", 1, 200, total=3) == [[1], []] and b.restore("/b", 1, 1) is None
    assert b.restore("/a", 1, 50) is None and b.sources == {}
    for i in range(300):
        b.keep(f"/{i}", 1, 1, [[1]], f"{i:04}")
    assert len(b.sources) == 256 and "/0" not in b.sources
    b.keep("/299", 1, 1, [[], []])
    assert "/299" not in b.sources
    (tmp_path / "bad.json").write_text("{")
    assert sinks.Bookmarks(tmp_path / "bad.json").sources == {}


def heap_merge(streams):
    heads, out = [(s[0] if s[0] is not None else order.UNTIMED_ORDER, i, 0) for i, s in enumerate(streams) if s], []
    heapq.heapify(heads)
    while heads:
        _, i, k = heapq.heappop(heads)
        out.append((i, k))
        if k + 1 < len(streams[i]):
            t = streams[i][k + 1]
            heapq.heappush(heads, (t if t is not None else order.UNTIMED_ORDER, i, k + 1))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_merge_equals_a_heap(spark, seed):
    r = random.Random(seed)
    streams = [[None if r.random() < 0.2 else r.choice([r.randrange(40), 7]) for _ in range(r.randrange(0, 60))] for _ in range(r.randint(1, 4))]
    rows = [(i, k, t) for i, s in enumerate(streams) for k, t in enumerate(s)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "source_id int, seq long, ts_micros long")
    ready = order.running(d, F.coalesce("ts_micros", F.lit(order.UNTIMED_ORDER)), "max", "__ready", chunk_rows=4)
    got = order.dense_ids(ready, "__ready", ("source_id", "seq"), ranges=5, chunk_rows=3).orderBy("line_id").collect()
    assert [(x["source_id"], x["seq"]) for x in got] == heap_merge(streams)
    assert [x["line_id"] for x in got] == list(range(len(rows)))


def test_merged_files(spark, put):
    line = lambda s: f'{{"ts":"2026-06-01T12:00:{s:02}Z"}}\n'
    a, b = put("a.log", (line(10) + line(30) + line(50)).encode()), put("b.log", ("x\n" + line(20) + line(5) + line(40)).encode())
    got = LogEngine.open(spark, [a, b], format="ndjson").records.orderBy("line_id").collect()
    assert [r["source_id"] for r in got] == [1, 0, 1, 1, 0, 1, 0] and [r["line_id"] for r in got] == list(range(7))


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_a_loop(spark, seed):
    r = random.Random(seed)
    rows = {s: [r.choice(["head", "  more", "\tat x"]) + str(k) for k in range(r.randint(1, 40))] for s in range(3)}
    want = set()
    for s, lines in rows.items():
        out = []
        for x in lines:
            if out and x[0] in " \t":
                out[-1] += "\n" + x
            else:
                out.append(x)
        want |= {(s, i, x) for i, x in enumerate(out)}
    d = spark.createDataFrame([(s, k, x) for s, lines in rows.items() for k, x in enumerate(lines)], "source_id int, seq long, raw string")
    order.running.__defaults__ = (*order.running.__defaults__[:-1], 5)
    try:
        got = order.fold_lines(d, SourceSpec("logfmt").line_format().continues())
        assert {(x["source_id"], x["seq"], x["raw"]) for x in got.collect()} == want
    finally:
        order.running.__defaults__ = (*order.running.__defaults__[:-1], order.CHUNK_ROWS)


def test_fold_option(spark, put):
    path = put("t.log", b"ts=2026-06-01T12:00:00Z a=1\n    at x\n    at y\nts=2026-06-01T12:00:01Z b=2\n")
    count = lambda **o: LogEngine.open(spark, path, format="logfmt", **o).records.count()
    assert (count(), count(fold="reference"), count(fold="never")) == (2, 4, 4)
