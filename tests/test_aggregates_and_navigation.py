import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import aggregates as A
from logweave.operators import navigation as N
from logweave.plans.engine import LogEngine

SCHEMA = "source_id int, line_id long, ts_micros long, severity tinyint, raw string"


@pytest.fixture
def view(spark):
    def make(times, severity=None, raw="x"):
        return spark.createDataFrame([(0, i, t, (severity or (lambda i: 3))(i), raw) for i, t in enumerate(times)], SCHEMA)

    return make


def brute(rows, bins, window=None):
    timed = [(t, s) for t, s in rows if t is not None]
    if not timed and window is None or bins <= 0:
        return {}
    lo, upper = (min(timed)[0], max(timed)[0] + 1) if window is None else (window[0], window[1] + 1)
    out = {b: [0] * 8 for b in range(bins)} if upper > lo else {}
    for t, s in timed:
        if lo <= t < upper:
            b = min((t - lo) * bins // (upper - lo), bins - 1)
            out[b][0] += 1
            out[b][1 + s] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_histograms_equal_brute_force(spark, view, seed):
    r = random.Random(seed)
    big = r.choice([1, 10**6, 2**61])
    times = [None if r.random() < 0.2 else r.randrange(100) * big // 50 for _ in range(r.randint(0, 80))]
    code = lambda i: (i * 7 + seed) % 7
    v, bins = view(times, code), r.choice([0, 1, 5, 13])
    for window in (None, (20 * big // 50, 60 * big // 50), (5, 2)):
        got = {g["bin"]: [g["count"], *(g[c] for c in A.COUNTERS)] for g in A.histogram(v, bins, window).collect()}
        assert got == brute([(t, code(i)) for i, t in enumerate(times)], bins, window)


def test_published_histograms(view):
    counts = lambda h: [r["count"] for r in h.orderBy("bin").collect()]
    seconds = [i * 1_000_000 for i in range(10)]
    assert counts(A.histogram(view(seconds), 5)) == [2] * 5
    assert sum(counts(A.histogram(view(seconds), 4, (3_000_000, 6_000_000)))) == 4
    edge = A.histogram(view([0, 100], lambda i: (3, 5)[i]), 5).orderBy("bin").collect()
    assert edge[0]["info"] == 1 and edge[4]["error"] == 1
    assert A.histogram(view([None] * 5), 3).count() == 0 and A.untimed(view([None] * 5)).first()[0] == 5
    h = A.histogram(view([0, 1, 2, 3], lambda i: (0, 1, 6, 3)[i]), 2)
    assert [r["dominant"] for r in A.dominant_severity(h).orderBy("bin").collect()] == [1, 6] and A.peak(h).first()[0] == 2
    assert [(r["err"], r["dbg"]) for r in A.bands(h).orderBy("bin").collect()] == [(0, 7), (7, 0)]


def test_statistics(spark, view):
    s = A.summary(view([1_000_000, None, 5_000_000])).first()
    assert (s["total"], s["timed"], s["untimed"], s["t_min"], s["t_max"]) == (3, 2, 1, 1_000_000, 5_000_000)
    s = A.summary(view([])).first()
    assert s["total"] == 0 and s["t_min"] is None
    e = LogEngine.of_lines(spark, [f'{{"user":"{u}"}}' for u in ("alice", "alice", "bob")] + ["{}"])
    assert [tuple(r) for r in e.top_values("user").collect()] == [("alice", 2, False), ("bob", 1, False)]
    assert e.top_values().first()["value"] == "alice"


def test_first_values_count(spark, view):
    values = [f"v{i}" for i in range(5)] + ["late"] * 9 + ["v0"]
    d = spark.createDataFrame([(0, i, None, 0, v) for i, v in enumerate(values)], SCHEMA)
    got = A.top_values(d, F.col("raw"), 3, distinct=4).collect()
    assert [tuple(r) for r in got] == [("v0", 2, True), ("v1", 1, True), ("v2", 1, True)]


def test_schema(spark):
    e = LogEngine.of_lines(spark, ['{"ts":"a","level":"b","msg":"c"}', '{"ts":"a","level":"b","msg":5,"extra":null}', '{"msg":"d","msg":"e"}', "no json", "{}"])
    assert {(r["field"], r["presence"], r["all_strings"]) for r in e.schema().collect()} == {("ts", 2, True), ("level", 2, True), ("msg", 3, False), ("extra", 1, False)}
    assert e.auto_columns(8) == ["msg", "extra"]
    flags = A.majority_flags(e.records).first()
    assert not flags["has_timestamps"] and not flags["has_severity"]


def test_middle_schema(spark):
    e = LogEngine.of_lines(spark, [f'{{"k{i}":1}}' for i in range(10)])
    assert sorted(r["field"] for r in A.middle_schema(e.records, 4).collect()) == ["k3", "k4", "k5", "k6"]


def test_lookups(spark, view):
    v = view([30, 10, 20, None, 40, 50, 5, 1, 2, 60]).where("line_id in (1, 4, 7, 9)")
    one = lambda d: d.first()[0]
    assert [one(N.snap_cursor(v, c)) for c in (4, 5, 0, 99)] == [4, 4, 1, 9] and one(N.snap_cursor(v.limit(0), 3)) is None
    assert [one(N.lower_bound(v, c)) for c in (0, 4, 5, 10)] == [1, 4, 7, None]
    assert one(N.jump_to_time(v, 35)) == 4 and one(N.jump_to_time(v, 45)) == 9 and one(N.jump_to_time(v, 100)) is None
    assert [N.move(v, 4, k).first()["line_id"] for k in (0, 1, -1, 99, -99)] == [4, 7, 1, 9, 1] and N.move(v, 5, 0).first()["line_id"] == 7 and N.move(v.limit(0), 1, 1).first() is None
    assert [r["line_id"] for r in N.page(v, 2, 2).collect()] == [4, 7] and [r["line_id"] for r in N.last_page(v, 2).collect()] == [7, 9]
    assert N.surviving(v, 4).count() == 1 and N.surviving(v, 5).count() == 0
    assert [N.next_bookmark([7, 1, 4], c) for c in (0, 1, 4, 7)] == [1, 4, 7, 1] and N.next_bookmark([], 3) is None
    assert N.column_limit(5, 3) == 3 and N.column_limit(0, 3) == 0


def test_scrub_and_zoom():
    assert N.scrub_range(0, 100, 10, 3) == (30, 39) and N.scrub_range(0, 5, 10, 2) == (2, 2) and N.scrub_range(0, 100, 10, 3, (7, 9)) == (7, 9)
    inner = N.zoom((0, 1000), None, 10, 5, True)
    assert inner == (300, 800)
    assert N.zoom((0, 1000), None, 10, 0, True) == (0, 500) and N.zoom((0, 1000), None, 10, 9, True) == (500, 1000)
    assert N.zoom((0, 1000), inner, 10, 5, False) is None


def test_detail_and_table(spark):
    e = LogEngine.of_lines(spark, ['{"ts":"2026-06-01T12:00:00Z","level":"info","a":"x"}', "plain"] * 8)
    near = N.detail(e.records, 6).orderBy("line_id").collect()
    assert [r["line_id"] for r in near] == list(range(1, 12)) and [r["line_id"] for r in near if r["is_cursor"]] == [6]
    assert "\n" in near[5]["pretty"] and near[0]["pretty"] is None
    rows = N.table_rows(e.records, ["a", "b"], [1]).orderBy("line_id").limit(2).collect()
    assert [tuple(r) for r in rows] == [(False, 0, "2026-06-01T12:00:00.000000", "info", "x", ""), (True, 1, "—", "?", "", "")]
    assert N.table_rows(e.records, []).columns[-1] == "raw"
