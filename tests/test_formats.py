import pytest
from pyspark.sql import functions as F

from logweave.operators.detect import detect_format, looks_like_array
from logweave.operators.formats import FORMATS, LineFormat, Parsed, SourceSpec, format_name, register_format
from logweave.operators.records import parse_lines
from logweave.plans.engine import LogEngine

T = 1780315200000000
UNTIMED, BAD_TS, BAD_LINE = "untimed", "bad_ts", "bad_line"
SYSLOG = '<134>1 2026-06-01T12:00:00Z host app 1 - [origin ip="10.0.0.1" port="443"] hi'
LOGBACK = "2026-06-01 12:00:00.123 INFO  [http-nio-8080-exec-1] c.e.Controller - hi"
PATTERN = r"(?P<ts>\d{4}(?:-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})?)\s+(?P<level>\w+)\s+(?P<msg>.*)"
#: format, options, line, time or status, severity, fields
CASES = [
    ("ndjson", {}, '{"ts":"2026-06-01T12:00:00Z","level":"info"}', T, 3, {"level": "info", "ts": "2026-06-01T12:00:00Z"}),
    ("ndjson", {}, "{}", UNTIMED, 0, {"x": None}),
    ("ndjson", {}, '{"ts":"not a date","level":"warn"}', BAD_TS, 4, {}),
    ("ndjson", {}, "just a raw line", BAD_LINE, 0, {"x": None}),
    ("ndjson", {}, '{"logger":"svc.tts","payload":{"n":5},"z":null,"a.b":"c"}', UNTIMED, 0, {"logger": "svc.tts", "payload": '{"n":5}', "missing": None, "z": "null", "a.b": "c"}),
    ("ndjson", {"time_field": "@timestamp", "level_field": "severity_text"}, '{"@timestamp":"2026-06-01T12:00:00Z","severity_text":"error"}', T, 5, {}),
    ("ndjson", {"exact": True}, '{"n": 1.50, "o": {"k": 1}, "s": "x\\"y", "z": null, "d": 1, "d": 2}', UNTIMED, 0, {"n": "1.50", "o": '{"k": 1}', "s": 'x\\"y', "z": "null", "d": "2"}),
    ("ndjson", {"exact": True}, '{"a":1}x', BAD_LINE, 0, {"a": None}),
    ("ndjson", {"exact": True}, "{'a':1}", BAD_LINE, 0, {"a": None}),
    ("ndjson", {"exact": True}, '{"ts":5,"level":"info"}', BAD_LINE, 0, {"level": "info"}),
    ("ndjson", {"exact": True, "time_field": "t"}, '{"t":5,"level":"info"}', UNTIMED, 3, {}),
    ("logfmt", {}, "ts=2026-06-01T12:00:00Z level=info msg=hi", T, 3, {"msg": "hi", "none": None}),
    ("logfmt", {}, 'msg="hello \\"world\\"" path="C:\\\\Users\\\\foo"', UNTIMED, 0, {"msg": 'hello "world"', "path": "C:\\Users\\foo"}),
    ("logfmt", {}, "warn level=info", UNTIMED, 3, {"warn": ""}),
    ("logfmt", {}, "not a logfmt line at all", UNTIMED, 0, {"logfmt": ""}),
    ("logfmt", {}, " \t ", BAD_LINE, 0, {}),
    ("logfmt", {}, 'a=1 a=2 ts=2026-06-01T12:00:00Z ts=bad level=info level=warn open="rest of it', T, 4, {"a": "1", "open": "rest of it"}),
    ("logfmt", {}, "ts=bad =x =y=z", BAD_TS, 0, {"x": "", "y": "z"}),
    ("edn", {}, '{:log/ts "2026-06-01T12:00:00Z" :level :info}', T, 3, {"ts": "2026-06-01T12:00:00Z", "level": "info"}),
    ("edn", {}, '{"ts" "2026" "level" "error" :n 5, :ok true}', BAD_TS, 5, {"ts": "2026", "n": "5", "ok": "true"}),
    ("edn", {}, '{:ts #inst "2026-06-01T12:00:00Z" :payload {:n [5 "}"]} :id #uuid "u" :s "a\\"b" :a 1 :a 2}', T, 0, {"payload": None, "id": "u", "s": 'a"b', "a": "1"}),
    ("edn", {}, "this is not edn at all", BAD_LINE, 0, {"x": None}),
    ("python", {}, "2026-06-01 12:00:00,123 - my.module - INFO - server - started ", T + 123000, 3, {"logger": "my.module", "level": "INFO", "msg": "server - started", "ts": "2026-06-01 12:00:00,123", "x": None}),
    ("python", {}, "no separators", BAD_LINE, 0, {"ts": None}),
    ("python", {}, "bad time - m - ERROR - x", BAD_TS, 0, {"level": "ERROR"}),
    ("python", {}, "2026-06-01 12:00:00 - only", T, 0, {"logger": None, "ts": "2026-06-01 12:00:00"}),
    ("python", {}, "2026-06-01 12:00:00 - m - WARN", T, 4, {"msg": "", "level": "WARN"}),
    ("syslog", {}, SYSLOG, T, 3, {"origin.ip": "10.0.0.1", "origin.port": "443", "origin": "", "msg": "hi", "host": "host", "msgid": None, "level": "info", "other": None, "origin.x": None}),
    ("syslog", {}, "<131>1 - h a p m -", UNTIMED, 5, {"msg": "", "level": "error", "ts": None}),
    ("syslog", {}, "<2>1 2026-06-01T12:00:00Z h a p m - x y", T, 6, {"msg": "x y"}),
    ("syslog", {}, "<15>1 bad h a p m", BAD_TS, 2, {"msg": "", "msgid": "m"}),
    ("syslog", {}, '<13>1 - h a p m [exo msg="with \\"quote\\"" k="a\\]b"][two] tail', UNTIMED, 3, {"exo.msg": 'with "quote"', "exo.k": "a]b", "two": "", "msg": "tail"}),
    ("syslog", {}, "<99999999999>1 - h a p m -", BAD_LINE, 0, {"host": None}),
    ("syslog", {}, "plain", BAD_LINE, 0, {"msg": None}),
    ("csv", {"header": ("ts", "level", "host", "msg")}, '2026-06-01T12:00:01Z,error,host02,"timeout, ""retry"""', T + 1_000_000, 5, {"msg": 'timeout, "retry"', "_3": "host02", "_99": None, "none": None}),
    ("csv", {"header": ("ts", "level")}, "ts,level", BAD_TS, 0, {"ts": "ts"}),
    ("csv", {"header": ("a", "b", "c")}, "a,b,", UNTIMED, 0, {"a": "a", "c": ""}),
    ("csv", {"header": ("a", "b", "c")}, ",b,c", UNTIMED, 0, {"a": "", "b": "b", "c": "c"}),
    ("csv", {"header": ("a", "b", "c")}, '"he"llo,"open,', UNTIMED, 0, {"a": "he", "b": "llo", "c": "open,"}),
    ("tsv", {"header": ("ts", "level")}, "2026-06-01T12:00:00Z\twarn", T, 4, {"_2": "warn"}),
    ("access", {}, '1.2.3.4 - admin [01/Jun/2026:12:00:00 +0000] "GET /api HTTP/1.1" 200 1234', T, 3, {"ip": "1.2.3.4", "host": "1.2.3.4", "logname": None, "user": "admin", "status": "200", "bytes": "1234", "method": "GET", "uri": "/api", "protocol": "HTTP/1.1", "referer": None, "level": "info", "ts": None}),
    ("access", {}, '::1 - - [01/Jun/2026:14:00:00 +0200] "GET /a\\"b HTTP/1.1" 502 - "" "ua \\\\ x"', T, 5, {"request": 'GET /a"b HTTP/1.1', "bytes": None, "referer": "", "user_agent": "ua \\ x", "level": "error"}),
    ("access", {}, 'h - - [01/Foo/2026:12:00:00 +0000] "GET" 404 1', BAD_TS, 4, {"method": None, "request": "GET"}),
    ("access", {}, 'h - - [01/Jun/2026:12:00:00 +0000] "GET / H" 99', T, 0, {"bytes": "", "level": "?"}),
    ("access", {}, 'h - - [01/Jun/2026:12:00:00 +0000] "GET / H" 200 1 "open', BAD_LINE, 0, {"ip": None}),
    ("logback", {}, LOGBACK, T + 123000, 3, {"thread": "http-nio-8080-exec-1", "logger": "c.e.Controller", "msg": "hi", "level": "INFO", "ts": "2026-06-01 12:00:00.123"}),
    ("logback", {}, "2026-06-01 12:00:00 SEVERE logger - a - b", T, 0, {"thread": None, "logger": "logger", "msg": "a - b"}),
    ("logback", {}, "2026-06-01 12:00:00 ERROR no separator", T, 5, {"logger": None, "msg": "no separator"}),
    ("logback", {}, "2026-06-01 12:00:00 ERROR [open", BAD_LINE, 0, {"msg": None}),
    ("journalctl", {}, '{"__REALTIME_TIMESTAMP":"1717235400123456","PRIORITY":"6","MESSAGE":"hello"}', 1717235400123456, 3, {"msg": "hello", "level": "info"}),
    ("journalctl", {}, '{"__REALTIME_TIMESTAMP":1717235400123456,"PRIORITY":4,"_HOSTNAME":"h","_SYSTEMD_UNIT":"u"}', 1717235400123456, 4, {"host": "h", "unit": "u", "level": "warn", "ident": None}),
    ("journalctl", {}, '{"__REALTIME_TIMESTAMP":"x","PRIORITY":"9"}', BAD_TS, 0, {"level": "?"}),
    ("journalctl", {}, "not json", UNTIMED, 0, {"level": None}),
    ("regex", {"pattern": PATTERN}, "2026-06-01 12:00:00 INFO server started", T, 3, {"msg": "server started", "level": "info"}),
    ("regex", {"pattern": PATTERN}, "2026 boot x", 1767225600000000, 0, {"level": "boot"}),
    ("regex", {"pattern": r"(?P<level>\w+): (?P<msg>.*)"}, "WARN: queue full", UNTIMED, 4, {"level": "warn", "none": None}),
    ("regex", {"pattern": r"^(?P<level>[A-Z]+)$"}, "nope", BAD_LINE, 0, {"level": None}),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_lines(spark, i):
    name, options, line, when, severity, fields = CASES[i]
    spec = SourceSpec(name, **options)
    lines = spark.createDataFrame([(0, 1, line)], "source_id int, seq long, raw string")
    made = spec.line_format()
    got = parse_lines(lines, spec).select("*", *(made.project(k).alias(f"f{j}") for j, k in enumerate(fields))).first()
    status = got["ts_micros"] if got["ts_micros"] is not None else BAD_LINE if got["bad_line"] else BAD_TS if got["bad_ts"] else UNTIMED
    assert (status, got["severity"], {k: got[f"f{j}"] for j, k in enumerate(fields)}) == (when, severity, fields)


def test_names():
    assert [format_name(x) for x in ("log4j", "java", "journal", "systemd", "ndjson")] == ["logback", "logback", "journalctl", "journalctl", "ndjson"]
    with pytest.raises(ValueError, match="unknown --format"):
        format_name("protobuf")
    with pytest.raises(ValueError):
        SourceSpec("regex").line_format()


def test_own_format(spark):
    class Pipes(LineFormat):
        def parse(self):
            return Parsed(F.lit(None).cast("bigint"), F.lit(3).cast("tinyint"), F.lit(False), ~F.col("raw").contains("|"))

        def project(self, key):
            return F.get(F.split("raw", r"\|"), F.lit(int(key)))

    register_format("pipes", Pipes)
    try:
        got = LogEngine.of_lines(spark, ["a|b", "c|d"], SourceSpec("pipes")).scan("1=d").collect()
        assert [r["line_id"] for r in got] == [1]
    finally:
        del FORMATS["pipes"]


@pytest.mark.parametrize(
    "lines,want",
    [
        ([SYSLOG] * 2, "syslog"), (['1.2.3.4 - - [01/Jun/2026:12:00:00 +0000] "GET / HTTP/1.1" 200 1'] * 2, "access"), ([LOGBACK] * 2, "logback"), (['{"__REALTIME_TIMESTAMP":"1"}'] * 2, "journalctl"), (['{:a 1}', "{ #inst 2}"], "edn"), (["a=1 b=2", 'x="q r" y=3'], "logfmt"), (['{"a":1}'] * 2, "ndjson"),
        (["a\tb\tc"] * 2, "tsv"), (["a,b,c"] * 2, "csv"), (["plain text"] * 5, "ndjson"), ([SYSLOG], "ndjson"), (['{"a":1}'] * 3 + ["a=1 b=2"] * 2, "ndjson"), ([SYSLOG] * 2 + ["a,b,c"] * 5, "syslog"), (['"a,b",c,d'] * 2, "csv"), (["a=1 b"] * 3, "ndjson"), ([], "ndjson"),
    ],
)
def test_detection(lines, want):
    assert detect_format(x.encode() for x in lines) == want


def test_array_heads():
    assert looks_like_array(b' \n[ {"a"') and looks_like_array(b"[]") and not looks_like_array(b"[1]") and not looks_like_array(b"{")
