"""Registered queries of the log engine and their DuckDB equivalents.

The tables hold no log text, so each query first writes the rows of ``events`` as lines of a format and
then reads these lines through the engine; the SQL works on the original columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.record import rfc3339_micros, severity_name
from logweave.operators import aggregates, navigation, order, records
from logweave.operators.formats import SourceSpec, project_any
from logweave.operators.predicates import SeverityIn, minimum_and_above
from logweave.plans.dsl import compile_query
from logweave.plans.view import ViewSpec

#: Severity of an event, by its type. Every 50th event is written without a time and every third with a logger.
LEVEL = {"error": 5, "signup": 4, "purchase": 3, "click": 2, "view": 1}
ACCESS_STATUS = {5: 503, 4: 404, 3: 200, 2: 302, 1: 101}
PRI = {5: 131, 4: 132, 3: 134, 2: 135, 1: 130}
MID = "2024-01-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code() -> Column:
    out = F.lit(0)
    for kind, code in LEVEL.items():
        out = F.when(F.col("event_type") == kind, code).otherwise(out)
    return out


def _by_code(values: dict[int, int]) -> Column:
    out = F.lit(0)
    for code, v in values.items():
        out = F.when(F.col("code") == code, v).otherwise(out)
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with its time as text, severity code and level name; every 50th without a time."""
    rows = table(spark, sf_dir, "events").withColumn("code", _code())
    stamp = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z"))
    return rows.withColumn("stamp", stamp).withColumn("level", severity_name(F.col("code"))).withColumn("timed", F.col("event_id") % 50 != 7).withColumn("logger", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("app."), "event_type")))


def _ndjson() -> Column:
    part = lambda name, value: F.concat(F.lit(f',"{name}":"'), value, F.lit('"'))
    return F.concat(
        F.lit('{"level":"'), "level", F.lit('"'), F.when(F.col("timed"), part("ts", F.col("stamp"))).otherwise(F.lit("")), F.coalesce(part("logger", F.col("logger")), F.lit("")),
        part("user", F.col("user_id").cast("string")), F.lit(',"props":'), "props", F.lit("}"),
    )


def lines_of(events: DataFrame, raw: Column) -> DataFrame:
    return events.select(F.lit(0).alias("source_id"), F.col("event_id").alias("seq"), raw.alias("raw"))


def ndjson_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_lines(lines_of(_events(spark, sf_dir), _ndjson()), SourceSpec()).withColumnRenamed("seq", "line_id")


def project(key: str) -> Column:
    return project_any({0: SourceSpec()}, key)


#: The same record table from the columns.
R = """WITH r AS (
  SELECT event_id AS line_id, CASE WHEN event_id % 50 <> 7 THEN epoch_us(ts) END AS ts_micros,
    CAST(CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS TINYINT) AS severity,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'info' WHEN 'click' THEN 'debug' WHEN 'view' THEN 'trace' ELSE '?' END AS level,
    CASE WHEN event_id % 3 = 0 THEN 'app.' || event_type END AS logger, CAST(user_id AS VARCHAR) AS user, event_type, user_id, value, props, ts
  FROM events)
"""
MATCHED = "line_id, ts_micros, severity"


def _filtered(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ndjson_records(spark, sf_dir).where(compile_query(query).column(project)).select("line_id", "ts_micros", "severity")

    return run


def _viewed(spec: ViewSpec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spec.apply(ndjson_records(spark, sf_dir), project).select("line_id", "ts_micros", "severity")

    return run


def _at(text: str) -> str:
    return f"epoch_us(TIMESTAMP '{text}')"


#: name -> (query text, SQL condition)
FILTERS = {
    "field_equals": ("level=error", "level = 'error'"),
    "field_equals_missing": ("logger=app.error", "coalesce(logger = 'app.error', false)"),
    "field_regex": ("logger~/^app\\.(click|view)$/", "coalesce(logger IN ('app.click', 'app.view'), false)"),
    "not_missing_true": ("logger!=app.error", "NOT coalesce(logger = 'app.error', false)"),
    "or_precedence": ("level=error OR level=info AND logger=app.purchase", "level = 'error' OR (level = 'info' AND coalesce(logger = 'app.purchase', false))"),
    "paren_override": ("(level=error OR level=warn) AND logger~app", "level IN ('error', 'warn') AND logger IS NOT NULL"),
    "double_not": ("NOT NOT level=warn", "level = 'warn'"),
    "not_time_includes_untimed": (f"NOT ts>={MID}", f"NOT coalesce(ts_micros >= {_at(MID)}, false)"),
    "time_gt": (f"ts>{MID}T12:00:00Z", f"ts_micros > {_at(MID + ' 12:00:00')}"),
    "time_ge": (f"ts>={MID}T12:00:00Z", f"ts_micros >= {_at(MID + ' 12:00:00')}"),
    "time_lt": (f"ts<{MID}T12:00:00Z", f"ts_micros < {_at(MID + ' 12:00:00')}"),
    "time_le": (f"ts<={MID}T12:00:00Z", f"ts_micros <= {_at(MID + ' 12:00:00')}"),
    "time_prefix_padding": ("ts>=2024-01 AND ts<2024-01-20T06", f"ts_micros >= {_at('2024-01-01')} AND ts_micros < {_at('2024-01-20 06:00:00')}"),
    "time_equals_text": ("ts=2024", "false"),
    "nested_value_regex": ('props~/"k": ?[0-4]/', "regexp_matches(props, '\"k\": ?[0-4]')"),
}
#: name -> (view, SQL condition)
VIEWS = {
    "severity_filter": (ViewSpec(severities=(5, 3)), "severity IN (5, 3)"),
    "severity_min_mode": (ViewSpec(severities=(3, 5), at_least=True), "severity >= 3"),
    "severity_preset": (ViewSpec().with_preset(4), "severity IN (1, 2)"),
    "raw_regex": (ViewSpec(regex=r'"user":"\d*7"'), "user LIKE '%7'"),
    "field_filter_text": (ViewSpec().with_field(" level = warn "), "level = 'warn'"),
    "time_range_inclusive": (ViewSpec(time_range=(1705276800000000, 1705363200000000)), "ts_micros BETWEEN 1705276800000000 AND 1705363200000000"),
    "view_stack_all": (ViewSpec(regex="app", severities=(2,), at_least=True, query="NOT level=info", time_range=(1704067200000000, 1706745600000000)).with_field("level=error"), "severity >= 2 AND level = 'error' AND logger IS NOT NULL AND ts_micros BETWEEN 1704067200000000 AND 1706745600000000"),
}


def _bins_sql(bins: int, where: str = "true", window: tuple[int, int] | None = None) -> str:
    bounds = "(SELECT min(ts_micros) AS lo, max(ts_micros) + 1 AS upper FROM v)" if window is None else f"(SELECT {window[0]} AS lo, {window[1] + 1} AS upper)"
    inside = "ts_micros IS NOT NULL" if window is None else f"ts_micros BETWEEN {window[0]} AND {window[1]}"
    counters = ", ".join(f"CAST(count(*) FILTER (WHERE severity = {k}) AS BIGINT) AS {c}" for k, c in enumerate(aggregates.COUNTERS))
    return f"""{R}, v AS (SELECT * FROM r WHERE {where}), b AS {bounds},
c AS (SELECT CAST(least((CAST(ts_micros AS HUGEINT) - lo) * {bins} // (upper - lo), {bins - 1}) AS INTEGER) AS bin, count(*) AS count, {counters} FROM v, b WHERE {inside} GROUP BY 1),
h AS (SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(count, 0) AS count, {", ".join(f"coalesce({c}, 0) AS {c}" for c in aggregates.COUNTERS)} FROM range({bins}) g(bin) LEFT JOIN c ON c.bin = g.bin)
"""


ZOOM = (1704412800000000, 1705622399999999)
HISTOGRAMS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "hist_full": (lambda v: aggregates.histogram(v, 60), _bins_sql(60) + "SELECT * FROM h"),
    "hist_filtered": (lambda v: aggregates.histogram(v.where(compile_query("level=error AND logger~app").column(project)), 40), _bins_sql(40, "level = 'error' AND logger IS NOT NULL") + "SELECT * FROM h"),
    "hist_zoom": (lambda v: aggregates.histogram(v, 48, ZOOM), _bins_sql(48, window=ZOOM) + "SELECT * FROM h"),
    "hist_empty_bins": (lambda v: aggregates.histogram(v, 997, (0, 2 * ZOOM[1])), _bins_sql(997, window=(0, 2 * ZOOM[1])) + "SELECT * FROM h"),
    "hist_dominant": (lambda v: aggregates.dominant_severity(aggregates.histogram(v, 500)), _bins_sql(500) + "SELECT bin, CASE WHEN fatal > 0 THEN 6 WHEN error > 0 THEN 5 WHEN warn > 0 THEN 4 WHEN info > 0 THEN 3 WHEN debug > 0 THEN 2 WHEN trace > 0 THEN 1 ELSE 0 END AS dominant FROM h"),
    "hist_peak": (lambda v: aggregates.peak(aggregates.histogram(v, 60)), _bins_sql(60) + "SELECT max(count) AS peak FROM h"),
    "hist_bands": (lambda v: aggregates.bands(aggregates.histogram(v, 60)), _bins_sql(60) + "SELECT bin, CAST((error + fatal) * 7 // greatest(max(error + fatal) OVER (), 1) AS BIGINT) AS err, CAST(warn * 7 // greatest(max(warn) OVER (), 1) AS BIGINT) AS warn, CAST(info * 7 // greatest(max(info) OVER (), 1) AS BIGINT) AS info, CAST((debug + trace) * 7 // greatest(max(debug + trace) OVER (), 1) AS BIGINT) AS dbg FROM h"),
    "hist_untimed": (aggregates.untimed, R + "SELECT count(*) FILTER (WHERE ts_micros IS NULL) AS untimed FROM r"),
}


def _top_sql(value: str, n: int) -> str:
    return f"""{R}, c AS (SELECT {value} AS value, count(*) AS count, min(line_id) AS f FROM r WHERE {value} IS NOT NULL GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY f) AS k, count(*) OVER () > 1024 AS high_card FROM c)
SELECT value, count, high_card FROM k WHERE k <= 1024 ORDER BY count DESC, value LIMIT {n}"""


_SUMMARY = ", ".join(f"count(*) FILTER (WHERE severity = {k}) AS {c}" for k, c in enumerate(aggregates.COUNTERS))
_SCHEMA = """SELECT field, CAST(sum(n) AS BIGINT) AS presence, field <> 'props' AS all_strings FROM (
  SELECT unnest([{'f': 'level', 'n': 1}, {'f': 'ts', 'n': CASE WHEN ts_micros IS NOT NULL THEN 1 ELSE 0 END}, {'f': 'logger', 'n': CASE WHEN logger IS NOT NULL THEN 1 ELSE 0 END}, {'f': 'user', 'n': 1}, {'f': 'props', 'n': 1}], recursive := true) FROM s) t(field, n) GROUP BY field"""
AGGREGATES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "stats_summary": (aggregates.summary, f"{R} SELECT count(*) AS total, count(ts_micros) AS timed, count(*) - count(ts_micros) AS untimed, min(ts_micros) AS t_min, max(ts_micros) AS t_max, {_SUMMARY} FROM r"),
    "stats_top_values": (lambda v: aggregates.top_values(v, project("logger"), 8), _top_sql("logger", 8)),
    "stats_top_highcard_1024": (lambda v: aggregates.top_values(v, project("user"), 25), _top_sql("user", 25)),
    "schema_presence": (aggregates.schema_scan, f"{R}, s AS (SELECT * FROM r WHERE line_id < 10000) {_SCHEMA}"),
    "rescan_schema_middle": (lambda v: aggregates.middle_schema(v.where(compile_query("level=error").column(project)), 500), f"{R}, v AS (SELECT *, row_number() OVER (ORDER BY line_id) - 1 AS k, count(*) OVER () AS n FROM r WHERE level = 'error'), s AS (SELECT * FROM v WHERE k >= (n - least(n, 500)) // 2 AND k < (n - least(n, 500)) // 2 + least(n, 500)) {_SCHEMA}"),
    "auto_columns": (lambda v: v.sparkSession.createDataFrame([(i, c) for i, c in enumerate(aggregates.auto_columns(aggregates.schema_scan(v), 8))], "place int, field string"), f"{R}, s AS (SELECT * FROM r WHERE line_id < 10000), f AS ({_SCHEMA}) SELECT CAST(row_number() OVER (ORDER BY presence DESC, field) - 1 AS INTEGER) AS place, field FROM f WHERE field NOT IN ('ts', 'level') ORDER BY 1 LIMIT 8"),
    "majority_flags": (aggregates.majority_flags, f"{R} SELECT count(ts_micros) * 2 > count(*) AS has_timestamps, count(*) FILTER (WHERE severity > 0) * 2 > count(*) AS has_severity FROM r"),
    "parse_status_counts": (lambda v: records.parse_status(v), f"{R} SELECT count(*) AS records, count(*) - count(ts_micros) AS untimed, CAST(0 AS BIGINT) AS ts_parse_errors, CAST(0 AS BIGINT) AS line_parse_errors FROM r"),
}


def _levels(v: DataFrame) -> DataFrame:
    return v.where(SeverityIn(minimum_and_above((4, 5))).column(project))


def _scrub(v: DataFrame) -> DataFrame:
    low, high = aggregates.time_bounds(v)
    lo, hi = navigation.scrub_range(low, high + 1, 60, 17)
    return ViewSpec(time_range=(lo, hi)).apply(v, project).select("line_id", "ts_micros", "severity")


NAVIGATION: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "page": (lambda v: navigation.page(_levels(v), 300, 19).select("line_id", "severity"), f"{R} SELECT line_id, severity FROM r WHERE severity >= 4 AND line_id >= 300 ORDER BY line_id LIMIT 19"),
    "lower_bound": (lambda v: navigation.lower_bound(_levels(v), 333), f"{R} SELECT min(line_id) AS line_id FROM r WHERE severity >= 4 AND line_id >= 333"),
    "snap_cursor": (lambda v: navigation.snap_cursor(_levels(v), 501), f"{R} SELECT coalesce(max(line_id) FILTER (WHERE line_id <= 501), min(line_id)) AS line_id FROM r WHERE severity >= 4"),
    "jump_to_time": (lambda v: navigation.jump_to_time(_levels(v), 1705276800000000), f"{R} SELECT min(line_id) AS line_id FROM r WHERE severity >= 4 AND ts_micros >= 1705276800000000"),
    "cursor_move": (lambda v: navigation.move(_levels(v), 400, -12).select("line_id"), f"{R}, v AS (SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS k, count(*) OVER () AS n FROM r WHERE severity >= 4) SELECT line_id FROM v WHERE k = greatest(0, least(n - 1, (SELECT count(*) FROM v WHERE line_id < 400) - 12))"),
    "last_page": (lambda v: navigation.last_page(_levels(v)).select("line_id"), f"{R} SELECT line_id FROM r WHERE severity >= 4 ORDER BY line_id DESC LIMIT 20"),
    "detail_context": (lambda v: navigation.detail(v, 420).select("line_id", "is_cursor", F.get_json_object("pretty", "$.level").alias("level")), f"{R} SELECT line_id, line_id = 420 AS is_cursor, level FROM r WHERE line_id BETWEEN 415 AND 425"),
    "scrub_bin_range": (_scrub, f"{R}, b AS (SELECT min(ts_micros) AS lo, greatest((max(ts_micros) + 1 - min(ts_micros)) // 60, 1) AS w FROM r) SELECT {MATCHED} FROM r, b WHERE ts_micros BETWEEN lo + 17 * w AND lo + 18 * w - 1"),
    "table_rows": (lambda v: navigation.table_rows(v, ["logger", "user"]).select("line_id", "severity", "logger", "user", F.substring("time", 1, 19).alias("time")), f"{R} SELECT line_id, level AS severity, coalesce(logger, '') AS logger, user, CASE WHEN ts_micros IS NULL THEN '—' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS time FROM r"),
}


def _over(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(ndjson_records(spark, sf_dir))


# Formats: a line is written from the columns, read through the engine, and fields are compared with the columns.
def _iso_comma() -> Column:
    return F.regexp_replace(F.regexp_replace("stamp", "Z$", ""), r"\.", ",")


def _format_lines() -> dict[str, tuple[SourceSpec, Column, dict[str, str]]]:
    """name -> (how to read, the line, projected field -> SQL)."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    up = F.upper("level")
    apache = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "dd/"), F.get(F.array(*map(F.lit, ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))), F.month("ts") - 1), F.date_format(F.col("ts").cast("timestamp_ntz"), "/yyyy:HH:mm:ss"), F.lit(" +0000"))
    status, pri = _by_code(ACCESS_STATUS), _by_code(PRI)
    join = F.concat
    return {
        "ndjson": (SourceSpec(), _ndjson(), {"user": "user", "logger": "logger", "level": "level"}),
        "ndjson_exact": (SourceSpec(exact=True), _ndjson(), {"user": "user", "logger": "logger", "level": "level", "props": "props"}),
        "logfmt": (SourceSpec("logfmt"), join(F.lit("ts="), F.translate("stamp", " ", "T"), F.lit(" level="), "level", F.lit(' msg="say \\"'), kind, F.lit('\\" now" user='), user, F.lit(" flag")), {"msg": "'say \"' || event_type || '\" now'", "user": "user", "flag": "''", "none": "CAST(NULL AS VARCHAR)"}),
        "edn": (SourceSpec("edn"), join(F.lit('{:event/ts #inst "'), "stamp", F.lit('" :level :'), "level", F.lit(", :user "), user, F.lit(' :props {:k [1 "}"]} "kind" "'), kind, F.lit('"}')), {"user": "user", "kind": "event_type", "props": "CAST(NULL AS VARCHAR)"}),
        "python": (SourceSpec("python"), join(_iso_comma(), F.lit(" - app."), kind, F.lit(" - "), up, F.lit(" - user - "), user), {"logger": "'app.' || event_type", "level": "upper(level)", "msg": "'user - ' || user"}),
        "syslog": (SourceSpec("syslog"), join(F.lit("<"), pri.cast("string"), F.lit(">1 "), F.translate("stamp", " ", "T"), F.lit(" host"), user, F.lit(" app - - [meta kind=\""), kind, F.lit('" note="a\\]b"][audit] hello '), user), {"host": "'host' || user", "procid": "CAST(NULL AS VARCHAR)", "meta.kind": "event_type", "meta.note": "'a]b'", "audit": "''", "msg": "'hello ' || user"}),
        "csv": (SourceSpec("csv", header=("ts", "level", "user", "note")), join(F.col("stamp"), F.lit(","), "level", F.lit(","), user, F.lit(',"a ""'), kind, F.lit('"", b"')), {"user": "user", "note": "'a \"' || event_type || '\", b'", "_3": "user", "_9": "CAST(NULL AS VARCHAR)"}),
        "tsv": (SourceSpec("tsv", header=("ts", "level", "user")), join(F.col("stamp"), F.lit("\t"), "level", F.lit("\t"), user), {"user": "user", "_2": "level"}),
        "access": (SourceSpec("access"), join(F.lit("10.0.0.1 - u"), user, F.lit(" ["), apache, F.lit('] "GET /'), kind, F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(' - "-" "agent \\"x\\""')), {"user": "'u' || user", "uri": "'/' || event_type", "bytes": "CAST(NULL AS VARCHAR)", "user_agent": "'agent \"x\"'"}),
        "logback": (SourceSpec("logback"), join(_iso_comma(), F.lit(" "), F.rpad(up, 5, " "), F.lit(" [t-"), user, F.lit("] c.e."), kind, F.lit(" - done "), user), {"thread": "'t-' || user", "logger": "'c.e.' || event_type", "level": "upper(level)", "msg": "'done ' || user"}),
        "journalctl": (SourceSpec("journalctl"), join(F.lit('{"__REALTIME_TIMESTAMP":"'), F.unix_micros(F.to_timestamp_ltz(F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("+00:00")))).cast("string"), F.lit('","PRIORITY":"'), (pri % 8).cast("string"), F.lit('","MESSAGE":"'), kind, F.lit('","_HOSTNAME":"h'), user, F.lit('"}')), {"msg": "event_type", "host": "'h' || user"}),
        "regex": (SourceSpec("regex", pattern=r"^(?P<ts>\S+ \S+?)Z \[(?P<level>\w+)\] (?P<user_id>\d+) (?P<msg>.*)$"), join(F.regexp_replace("stamp", r"(\.\d+)?Z$", "Z"), F.lit(" ["), "level", F.lit("] "), user, F.lit(" "), kind), {"user_id": "user", "msg": "event_type", "level": "level"}),
    }


FORMAT_NAMES = ("ndjson", "ndjson_exact", "logfmt", "edn", "python", "syslog", "csv", "tsv", "access", "logback", "journalctl", "regex")
#: What the format can hold of a time and a severity, in SQL, where that is not all.
_TIMES = {"ndjson": "ts_micros", "ndjson_exact": "ts_micros", "access": "epoch_us(date_trunc('second', ts))", "regex": "epoch_us(date_trunc('second', ts))"}
_CODES = {"access": "CASE severity WHEN 5 THEN 5 WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 2 THEN 3 ELSE 0 END", "syslog": "CASE severity WHEN 1 THEN 6 ELSE severity END", "journalctl": "CASE severity WHEN 1 THEN 6 ELSE severity END"}


def _round_trip(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, raw, fields = _format_lines()[name]
    named = {"f_" + k.replace(".", "_"): k for k in fields}
    parsed = records.parse_lines(lines_of(_events(spark, sf_dir), raw), spec, fields=named)
    return parsed.select(F.col("seq").alias("line_id"), "ts_micros", F.col("severity").cast("int").alias("severity"), "bad_line", *named)


#: The fields of ``_format_lines``, for the SQL (no session is needed here).
_FIELDS = {
    "ndjson": {"user": "user", "logger": "logger", "level": "level"},
    "ndjson_exact": {"user": "user", "logger": "logger", "level": "level", "props": "props"},
    "logfmt": {"msg": "'say \"' || event_type || '\" now'", "user": "user", "flag": "''", "none": "CAST(NULL AS VARCHAR)"},
    "edn": {"user": "user", "kind": "event_type", "props": "CAST(NULL AS VARCHAR)"},
    "python": {"logger": "'app.' || event_type", "level": "upper(level)", "msg": "'user - ' || user"},
    "syslog": {"host": "'host' || user", "procid": "CAST(NULL AS VARCHAR)", "meta.kind": "event_type", "meta.note": "'a]b'", "audit": "''", "msg": "'hello ' || user"},
    "csv": {"user": "user", "note": "'a \"' || event_type || '\", b'", "_3": "user", "_9": "CAST(NULL AS VARCHAR)"},
    "tsv": {"user": "user", "_2": "level"},
    "access": {"user": "'u' || user", "uri": "'/' || event_type", "bytes": "CAST(NULL AS VARCHAR)", "user_agent": "'agent \"x\"'"},
    "logback": {"thread": "'t-' || user", "logger": "'c.e.' || event_type", "level": "upper(level)", "msg": "'done ' || user"},
    "journalctl": {"msg": "event_type", "host": "'h' || user"},
    "regex": {"user_id": "user", "msg": "event_type", "level": "level"},
}


def _round_trip_sql(name: str) -> str:
    fields = "".join(f", {sql} AS f_{k.replace('.', '_')}" for k, sql in _FIELDS[name].items())
    return f"{R} SELECT line_id, {_TIMES.get(name, 'epoch_us(ts)')} AS ts_micros, CAST({_CODES.get(name, 'severity')} AS INTEGER) AS severity, false AS bad_line{fields} FROM r"


def access_status_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip("access", spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def rfc3339_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with offsets of whole and half hours to both sides."""
    shift = (F.col("event_id") % 27 - 13).cast("int")
    text = F.concat(F.regexp_replace("stamp", "Z$", ""), F.when(shift < 0, "-").otherwise("+"), F.lpad(F.abs(shift).cast("string"), 2, "0"), F.lit(":30"))
    return _events(spark, sf_dir).select(F.col("event_id").alias("line_id"), rfc3339_micros(text).alias("ts_micros"))


def rfc3339_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months 13 to 14 and days up to 60 roll over arithmetically."""
    n = F.col("event_id")
    text = F.concat(F.lit("2023-"), (n % 2 + 13).cast("string"), F.lit("-"), F.lpad((n % 60 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    return table(spark, sf_dir, "events").select(n.alias("line_id"), rfc3339_micros(text).alias("ts_micros"))


def merge_prefix_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events (some untimed) merged with orders, whose dates are not in order."""
    ev = ndjson_records(spark, sf_dir).select(F.lit(0).alias("source_id"), F.col("line_id").alias("seq"), "ts_micros")
    stamp = F.concat(F.col("o_orderdate").cast("timestamp_ntz").cast("string"), F.lit("Z"))
    od = _numbered_orders(spark, sf_dir, stamp)
    return order.merge_by_time(ev.unionByName(od)).select("line_id", "source_id", "seq", "ts_micros")


def _numbered_orders(spark: SparkSession, sf_dir: str, stamp: Column) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), rfc3339_micros(stamp).alias("ts_micros"))
    return order.dense_ids(rows.withColumn("zero", F.lit(0)), "key", ("zero", "key"), "seq").select(F.lit(1).alias("source_id"), "seq", "ts_micros")


_MERGE_SQL = f"""{R}, s AS (
  SELECT 0 AS source_id, line_id AS seq, ts_micros FROM r UNION ALL
  SELECT 1, row_number() OVER (ORDER BY o_orderkey) - 1, epoch_us(o_orderdate) FROM orders),
m AS (SELECT *, max(coalesce(ts_micros, -9223372036854775808)) OVER (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS pm FROM s)
SELECT row_number() OVER (ORDER BY pm, source_id, seq) - 1 AS line_id, source_id, seq, ts_micros FROM m"""


def fold_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation after its first are continuation lines."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n", " ").alias("text"))
    raw = F.concat(F.when(F.col("turn") == 0, F.concat(F.lit("conv="), F.col("conv_id").cast("string"), F.lit(" msg="))).otherwise("  "), F.coalesce("text", F.lit("")))
    lines = turns.groupBy("conv_id", "turn").agg(F.min(raw).alias("raw"))
    numbered = order.dense_ids(lines.withColumn("zero", F.lit(0)).withColumn("key", F.col("conv_id") * 1_000_000 + F.col("turn")), "key", ("zero", "turn"), "seq")
    folded = order.fold_lines(numbered.select(F.lit(0).alias("source_id"), "seq", "raw"), SourceSpec("logfmt").line_format().continues())
    return folded.select("seq", F.size(F.split("raw", "\n")).alias("lines"), F.md5(F.col("raw").cast("binary")).alias("digest"))


_FOLD_SQL = """WITH t AS (
  SELECT conv_id, turn, min(CASE WHEN turn = 0 THEN 'conv=' || conv_id || ' msg=' ELSE '  ' END || coalesce(replace(text, chr(10), ' '), '')) AS raw FROM conversations GROUP BY conv_id, turn),
n AS (SELECT *, sum(CASE WHEN turn = 0 OR k = 1 THEN 1 ELSE 0 END) OVER (ORDER BY conv_id, turn) AS g FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS k FROM t))
SELECT CAST(g - 1 AS BIGINT) AS seq, CAST(count(*) AS INTEGER) AS lines, md5(string_agg(raw, chr(10) ORDER BY conv_id, turn)) AS digest FROM n GROUP BY g"""


def fold_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into lines, each document a source; lines that start without a digit continue the record (Python rule)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("seq", "raw"))
    folded = order.fold_lines(docs.select(F.col("doc_id").alias("source_id"), F.col("seq").cast("long").alias("seq"), "raw"), SourceSpec("python").line_format().continues())
    return folded.select(F.col("source_id").alias("doc_id"), "seq", F.length("raw").alias("chars"))


_FOLD_TEXT_SQL = """WITH l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS raw, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: x <> ''), 1) AS k FROM documents),
n AS (SELECT *, sum(CASE WHEN k = 1 OR regexp_matches(raw, '^[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM l)
SELECT doc_id, CAST(g - 1 AS BIGINT) AS seq, CAST(sum(length(raw)) + count(*) - 1 AS INTEGER) AS chars FROM n GROUP BY doc_id, g"""


def raw_regex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Less mode: plain texts searched as they are."""
    rows = table(spark, sf_dir, "documents").select(F.lit(0).alias("source_id"), F.col("doc_id").alias("seq"), F.col("text").alias("raw"))
    return records.parse_lines(rows, SourceSpec()).where(ViewSpec(regex=r"\b[a-z]+tion\b").column(project)).select(F.col("seq").alias("doc_id"), "bad_line")


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each format's own lines, as the detector sees them (64 lines are its rule)."""
    from logweave.operators.detect import detect_format as detect

    found = []
    for name in FORMAT_NAMES:
        spec, raw, _ = _format_lines()[name]
        first = lines_of(_events(spark, sf_dir), raw).orderBy("seq").limit(64).collect()
        found.append((name, detect(r["raw"].encode() for r in first), spec.format))
    return spark.createDataFrame(found, "name string, detected string, written string")


def save_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save the warnings and graver as raw lines and read them back in order."""
    import uuid

    from logweave.sources import files, sinks
    from logweave.sources.shared import shared_folder

    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    sinks.save_view(_levels(ndjson_records(spark, sf_dir)), path)
    back = records.parse_lines(files.text_lines(spark, path), SourceSpec())
    return back.select("ts_micros", F.col("severity").cast("int").alias("severity"), project("user").alias("user"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per time bin under a filter."""
    view = ndjson_records(spark, sf_dir).where(compile_query("level=error AND ts>=2024-01-01").column(project))
    return aggregates.histogram(view, 24)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _filtered(q) for n, (q, _) in FILTERS.items()}
    found |= {n: _viewed(v) for n, (v, _) in VIEWS.items()}
    for group in (HISTOGRAMS, AGGREGATES, NAVIGATION):
        found |= {n: _over(f) for n, (f, _) in group.items()}
    found |= {f"fmt_{n}_roundtrip": partial(_round_trip, n) for n in FORMAT_NAMES}
    named = (access_status_severity, rfc3339_offsets, rfc3339_rollover, merge_prefix_max, fold_multiline, fold_raw_text, raw_regex_documents, detect_format, save_view)
    return found | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    found = {n: f"{R} SELECT {MATCHED} FROM r WHERE {sql}" for n, (_, sql) in [*FILTERS.items(), *VIEWS.items()]}
    for group in (HISTOGRAMS, AGGREGATES, NAVIGATION):
        found |= {n: sql for n, (_, sql) in group.items()}
    found |= {f"fmt_{n}_roundtrip": _round_trip_sql(n) for n in FORMAT_NAMES}
    return found | {
        "access_status_severity": f"SELECT severity, count(*) AS n FROM ({_round_trip_sql('access')}) GROUP BY severity",
        "rfc3339_offsets": "SELECT event_id AS line_id, epoch_us(ts) - CASE WHEN event_id % 27 < 13 THEN -1 ELSE 1 END * (abs(event_id % 27 - 13) * 60 + 30) * 60000000 AS ts_micros FROM events",
        "rfc3339_rollover": "SELECT event_id AS line_id, epoch_us(TIMESTAMP '2024-01-01' + to_months(CAST(event_id % 2 AS INTEGER)) + to_days(CAST(event_id % 60 AS INTEGER))) AS ts_micros FROM events",
        "merge_prefix_max": _MERGE_SQL,
        "fold_multiline": _FOLD_SQL,
        "fold_raw_text": _FOLD_TEXT_SQL,
        "raw_regex_documents": r"SELECT doc_id, true AS bad_line FROM documents WHERE regexp_matches(text, '(^|[^\pL\pN_])[a-z]+tion($|[^\pL\pN_])')",
        "save_view": f"{R} SELECT ts_micros, CAST(severity AS INTEGER) AS severity, user FROM r WHERE severity >= 4",
        "detect_format": "SELECT * FROM (VALUES ('ndjson','ndjson','ndjson'), ('ndjson_exact','ndjson','ndjson'), ('logfmt','logfmt','logfmt'), ('edn','edn','edn'), ('python','ndjson','python'), ('syslog','syslog','syslog'), ('csv','csv','csv'), ('tsv','tsv','tsv'), ('access','access','access'), ('logback','logback','logback'), ('journalctl','journalctl','journalctl'), ('regex','ndjson','regex')) t(name, detected, written)",
    }
