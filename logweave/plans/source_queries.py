"""Registered queries of files, writers, live tables, query texts and what a screen needs, and their DuckDB equivalents.

As in ``queries``, ``events`` is first written as log text; here that text goes through files, standard input, archives of
JSON arrays or a growing file, and what the engine makes of it is compared with the columns.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import aggregates, navigation, records
from logweave.operators.formats import SourceSpec, project_any
from logweave.plans import queries as Q
from logweave.plans.dsl import QueryError, compile_query
from logweave.plans.engine import LogEngine
from logweave.plans.view import ViewSpec, tabs
from logweave.sources import files, sinks
from logweave.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
#: Records in order of event_id, numbered without gaps.
N = f"{Q.R}, n AS (SELECT *, row_number() OVER (ORDER BY line_id) - 1 AS k FROM r)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._events(spark, sf_dir).select(F.col("event_id").alias("line_id"), Q._ndjson().alias("raw"))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _plain(spark: SparkSession, lines: DataFrame) -> str:
    path = _fresh(spark, "log")
    sinks.save_view(lines, path)
    return path


def _gzip(spark: SparkSession, lines: DataFrame, suffix: str = ".txt.gz") -> str:
    """Compressed files, under names that end with ``suffix``."""
    path = _fresh(spark, "log")
    lines.repartitionByRange("line_id").sortWithinPartitions("line_id").select("raw").write.option("compression", "gzip").text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.endswith(".txt.gz") and suffix != ".txt.gz":
            fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(path, name.removesuffix(".txt.gz") + suffix))
    return path


def _arrays(spark: SparkSession, lines: DataFrame, rows: int = 1000) -> str:
    """Files of one JSON array each."""
    path = _fresh(spark, "arrays")
    part = F.lpad(F.expr(f"line_id div {rows}").cast("string"), 12, "0").alias("part")
    own = F.transform(F.array_sort(F.collect_list(F.struct("line_id", "raw"))), lambda x: x["raw"])
    lines.groupBy(part).agg(F.concat(F.lit("["), F.array_join(own, ", "), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return path


def _shown(engine: LogEngine) -> DataFrame:
    return engine.records.select("line_id", "ts_micros", F.col("severity").cast("int").alias("severity"), engine.project("user").alias("user"))


_SHOWN_SQL = f"{N} SELECT k AS line_id, ts_micros, CAST(severity AS INTEGER) AS severity, user FROM n"
FILES: dict[str, Callable[[SparkSession, DataFrame], str]] = {"file_plain": _plain, "file_gzip": _gzip, "file_gzip_misnamed": partial(_gzip, suffix=".log"), "file_json_arrays": _arrays}


def _opened(write: Callable[[SparkSession, DataFrame], str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(LogEngine.open(spark, write(spark, _lines(spark, sf_dir)), cache=False))


def _texts(spark: SparkSession, lines: DataFrame) -> Iterator[str]:
    """The lines one after another, as a pipe would give them to the driver."""
    with tempfile.TemporaryDirectory(prefix="logweave-") as folder:
        _log_file(spark, lines, f"{folder}/a.log")
        with open(f"{folder}/a.log", encoding="utf-8", newline="\n") as f:
            yield from f


def stdin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard input, in pieces of 500 lines through the shared folder."""
    lines = files.spooled_lines(spark, _texts(spark, _lines(spark, sf_dir)), piece=500)
    parsed = records.parse_lines(lines, SourceSpec(), fields={"user": "user"})
    return parsed.select(F.col("seq").alias("line_id"), "ts_micros", F.col("severity").cast("int").alias("severity"), "user")


def stdin_and_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard input beside files is refused."""
    try:
        LogEngine.open(spark, ["-", f"{sf_dir}/a.log"])
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "message string")
    raise AssertionError("not refused")


def multi_file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files, the even and the odd events, merged by time."""
    lines = _lines(spark, sf_dir)
    paths = [_plain(spark, lines.where(F.col("line_id") % 2 == k)) for k in (0, 1)]
    return LogEngine.open(spark, paths, cache=False).records.select("line_id", "source_id", "ts_micros")


_INGEST_SQL = f"""{Q.R}, s AS (SELECT CAST(line_id % 2 AS INTEGER) AS source_id, row_number() OVER (PARTITION BY line_id % 2 ORDER BY line_id) AS seq, ts_micros FROM r),
m AS (SELECT *, max(coalesce(ts_micros, -9223372036854775808)) OVER (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS pm FROM s)
SELECT row_number() OVER (ORDER BY pm, source_id, seq) - 1 AS line_id, source_id, ts_micros FROM m"""


def dry_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a dry run prints."""
    engine = LogEngine.open(spark, _plain(spark, _lines(spark, sf_dir)), cache=False)
    return spark.createDataFrame([(engine.summary(),)], "summary string")


_SUMMARY_SQL = f"""{Q.R} SELECT 'indexed ' || count(*) || ' records — untimed: ' || (count(*) - count(ts_micros)) || ' (ts missing/bad: ' || (count(*) - count(ts_micros)) || '/0), json errors: 0' || chr(10)
  || 'schema: 5 fields scanned (' || least(count(*), 10000) || ' records in warmup), auto-columns: ["props", "user", "logger"]' AS summary FROM r"""


def default_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a field, the values of the first automatic column."""
    return LogEngine(Q.ndjson_records(spark, sf_dir), {0: SourceSpec()}).top_values()


def field_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and level under other names; the usual names are then ordinary fields."""
    raw = F.concat(F.lit('{"ts":"x","level":"fatal","when":"'), "stamp", F.lit('","sev.text":"'), "level", F.lit('"}'))
    spec = SourceSpec(time_field="when", level_field="sev.text")
    parsed = records.parse_lines(Q.lines_of(Q._events(spark, sf_dir), raw), spec, fields={"ts": "ts", "level": "level"})
    return parsed.select(F.col("seq").alias("line_id"), "ts_micros", F.col("severity").cast("int").alias("severity"), "ts", "level", "bad_ts")


def fields_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several fields from one reading of a line."""
    made = records.with_fields(Q.ndjson_records(spark, sf_dir), SourceSpec(exact=True), {"u": "user", "l": "logger", "p": "props"})
    return made.select("line_id", "u", "l", "p")


#: Malformed lines: every fourth event is no line of the format, the next one's time is broken.
#: format -> (SQL condition of bad_line, of bad_ts, of a kept severity).
_ODD = {"words": "line_id % 4 = 1", "time": "line_id % 4 = 2"}
MALFORMED = {
    "ndjson": ("words", "time", "time"), "logfmt": ("", "time", "time"), "edn": ("words", "time", "time"), "python": ("words", "time", ""), "syslog": ("words", "time", "time"),
    "csv": ("", "words time", "time"), "tsv": ("", "words time", "time"), "access": ("words", "time", "time"), "logback": ("words", "time", "time"), "journalctl": ("", "time", "time"), "regex": ("words", "time", "time"),
}

#: The year of a line's time, of which one digit is broken; the same digits may be a user or a fraction of a second.
_YEAR = r"(?<![0-9])([0-9]{2})[0-9]([0-9])(?=-[0-9]{2}-[0-9]{2}[T ]|:[0-9]{2}:[0-9]{2}:[0-9]{2})"


def _malformed(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, raw, _ = Q._format_lines()[name]
    broken = F.regexp_replace(raw, 'TIMESTAMP":"', 'TIMESTAMP":"x') if name == "journalctl" else F.regexp_replace(raw, _YEAR, "$1x$2")
    odd = F.when(F.col("event_id") % 4 == 1, "no such line").when(F.col("event_id") % 4 == 2, broken).otherwise(raw)
    events = Q._events(spark, sf_dir).withColumn("timed", F.lit(True))
    parsed = records.parse_lines(Q.lines_of(events, odd), spec)
    return parsed.select(F.col("seq").alias("line_id"), "ts_micros", F.col("severity").cast("int").alias("severity"), "bad_line", "bad_ts")


def _malformed_sql(name: str) -> str:
    bad_line, bad_ts, kept = (" OR ".join(_ODD[k] for k in kinds.split()) or "false" for kinds in MALFORMED[name])
    ts, code = Q._TIMES.get(name, "epoch_us(ts)").replace("ts_micros", "epoch_us(ts)"), Q._CODES.get(name, "severity")
    return f"""{Q.R} SELECT line_id, CASE WHEN line_id % 4 NOT IN (1, 2) THEN {ts} END AS ts_micros,
  CAST(CASE WHEN line_id % 4 NOT IN (1, 2) OR {kept} THEN {code} ELSE 0 END AS INTEGER) AS severity, ({bad_line}) AS bad_line, ({bad_ts}) AS bad_ts FROM r"""


#: Column -> (query text, SQL): characters of fields, keywords in capitals only, quoted, bare and pattern values, blanks at operators.
VALUES = {
    "field_characters": ("x-y.z@w_1=error", "event_type = 'error'"), "lower_case_words": ("and=1 OR or=3", "line_id % 7 IN (1, 3)"), "quoted": ('q="two words"', "line_id % 5 = 0"),
    "quoted_bracket": ('q="a)b"', "line_id % 5 = 1"), "bare": ("(n=3)", "line_id % 7 = 3"), "blanks": ("  n  =   3  ", "line_id % 7 = 3"), "no_blanks": ("n=3 AND(q=one)", "line_id % 7 = 3 AND line_id % 5 > 1"),
    "pattern": (r"q~/^\w+ w/", "line_id % 5 = 0"), "bare_pattern": ("q~^one$", "line_id % 5 > 1"), "not_equal": ("q!=one", "line_id % 5 <= 1"),
}


def query_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 7).cast("string")
    q = F.when(F.col("event_id") % 5 == 0, "two words").when(F.col("event_id") % 5 == 1, "a)b").otherwise("one")
    raw = F.concat(F.lit('{"x-y.z@w_1":"'), "event_type", F.lit('","and":"'), n, F.lit('","or":"'), n, F.lit('","n":"'), n, F.lit('","q":"'), q, F.lit('"}'))
    parsed = records.parse_lines(Q.lines_of(Q._events(spark, sf_dir), raw), SourceSpec())
    return parsed.select(F.col("seq").alias("line_id"), *(compile_query(text).column(Q.project).alias(c) for c, (text, _) in VALUES.items()))


#: Query text -> its error. Fixed values.
ERRORS = {
    "": "empty query", "  ": "empty query", "level>error": "comparison operators are only supported on `ts`", "ts>not-a-date": "could not parse timestamp `not-a-date`",
    "(level=error": "expected `)` to close group", "level=error AND": "expected field name", "AND=1": "expected field name", "level": "expected operator after `level`", "level=": "expected value",
}


def query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = []
    for text in ERRORS:
        try:
            compile_query(text)
        except QueryError as e:
            said.append((text, str(e)))
    return spark.createDataFrame(said, "query string, message string")


def views_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view cleared, its query blanked, and a broken query that leaves the old one in place."""
    spec = ViewSpec(regex="app", severities=(2, 5), query="level=error")
    try:
        kept = spec.with_query("level=")
    except QueryError:
        kept = spec
    made = {"cleared": spec.cleared(), "blanked": spec.with_query("  "), "kept": kept}
    rows = Q.ndjson_records(spark, sf_dir)
    return rows.agg(*(F.count_if(v.column(Q.project)).alias(name) for name, v in made.items()))


def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.ndjson_records(spark, sf_dir)
    return rows.agg(*(F.count_if(v.column(Q.project)).alias(name) for name, v in tabs(True).items()))


def zoomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window after a step inward on bin 17 of 60, and its rows."""
    rows = Q.ndjson_records(spark, sf_dir)
    start, end = navigation.zoom(aggregates.time_bounds(rows), None, 60, 17, True)
    inside = ViewSpec(time_range=(start, end)).apply(rows, Q.project)
    return inside.agg(F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("upto"), F.count(F.lit(1)).alias("n"))


_ZOOM_SQL = f"""{Q.R}, b AS (SELECT min(ts_micros) AS lo, max(ts_micros) AS hi FROM r),
z AS (SELECT lo + 17 * ((hi + 1 - lo) // 60) + (hi + 1 - lo) // 60 // 2 - (hi - lo) // 2 // 2 AS start, (hi - lo) // 2 AS span FROM b)
SELECT CAST(start AS BIGINT) AS start, CAST(start + span AS BIGINT) AS upto, count(*) AS n FROM r, z WHERE ts_micros BETWEEN start AND start + span GROUP BY 1, 2"""


def _error_lines(spark: SparkSession, sf_dir: str, n: int) -> list[int]:
    """What a user marks here: the first errors."""
    rows = Q.ndjson_records(spark, sf_dir).where(F.col("severity") == 5)
    return [r["line_id"] for r in rows.orderBy("line_id").limit(n).select("line_id").collect()]


def bookmarks_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty marks kept, saved and restored for a file that now has as many records as the eleventh mark says."""
    marks = _error_lines(spark, sf_dir, 20)
    with tempfile.TemporaryDirectory() as folder:
        book = sinks.Bookmarks(f"{folder}/marks.json")
        book.keep("a.log", 7, 100, [marks[::-1], []])
        book.save()
        restored = sinks.Bookmarks(f"{folder}/marks.json").restore("a.log", 7, 120, marks[10])
    return spark.createDataFrame([(m,) for m in restored[0]], "line_id long")


def next_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _error_lines(spark, sf_dir, 20)
    return spark.createDataFrame([(m, navigation.next_bookmark(marks, m)) for m in marks], "cursor long, next long")


def column_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(cap, asked, navigation.column_limit(cap, asked)) for cap in range(6) for asked in range(6)], "cap int, asked int, columns int")


def _log_file(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """A file that the driver can follow: the lines are written by all tasks, the JVM joins their files."""
    parts = _plain(spark, lines)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    to = jvm.java.io.FileOutputStream(path, True)
    try:
        for name in sorted(s.getPath().getName() for s in fs.listStatus(folder)):
            if name.startswith("part-"):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, to, 1 << 20, False)
                finally:
                    part.close()
    finally:
        to.close()
    fs.delete(folder, True)


def live_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file followed in batches of at most 64 KB into a table, drained and stopped; the counter counts all batches."""
    from logweave.streaming import live

    out = _fresh(spark, "live")
    with tempfile.TemporaryDirectory(prefix="logweave-") as folder:
        _log_file(spark, _lines(spark, sf_dir), f"{folder}/a.log")
        following = live.append_file(spark, f"{folder}/a.log", out, f"{out}-checkpoint", "10 milliseconds", max_bytes=1 << 16)
        try:
            following.processAllAvailable()
            counted = following.progress()
        finally:
            following.stop()
    table = following.table(spark)
    user = project_any({0: SourceSpec()}, "user").alias("user")
    return table.select("line_id", "ts_micros", F.col("severity").cast("int").alias("severity"), user, F.lit(counted).cast("long").alias("ingested"))


def rotated_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even events, then a rotation, then the odd ones, read on through the change; the driver holds a batch of 64 KB and a piece."""
    from logweave.streaming.tail import TailReader

    lines = _lines(spark, sf_dir)

    def read_on(path: str) -> Iterator[tuple[int, str]]:
        reader = TailReader(path, 1 << 16)
        at = reader.initialOffset()
        for k in (0, 1):
            _log_file(spark, lines.where(F.col("line_id") % 2 == k), path)
            while True:
                rows, after = reader.read(at)
                if after == at:
                    break
                yield from rows
                at = after
            os.rename(path, f"{path}.{k}")

    with tempfile.TemporaryDirectory(prefix="logweave-") as folder:
        kept = files.spooled_rows(spark, read_on(f"{folder}/a.log"), piece=500)
    parsed = records.parse_lines(kept, SourceSpec(), fields={"user": "user"})
    return parsed.select(F.col("seq").alias("line_id"), "ts_micros", "user")


def live_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a stream by day and severity."""
    from logweave.streaming import live

    path, name = _fresh(spark, "stream"), f"bins_{uuid.uuid4().hex}"
    table = Q.ndjson_records(spark, sf_dir).select("line_id", "ts_micros", "severity")
    table.write.parquet(path)
    bins = live.live_histogram(spark.readStream.schema(table.schema).parquet(path), "1 day")
    bins.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.unix_micros("window.start").alias("start"), "count", *aggregates.COUNTERS)


_LIVE_SQL = f"""{Q.R} SELECT ts_micros - ts_micros % 86400000000 AS start, count(*) AS count, {", ".join(f"count(*) FILTER (WHERE severity = {k}) AS {c}" for k, c in enumerate(aggregates.COUNTERS))}
FROM r WHERE ts_micros IS NOT NULL GROUP BY 1"""


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {n: partial(_opened, write) for n, write in FILES.items()}
    found |= {f"fmt_{n}_malformed": partial(_malformed, n) for n in MALFORMED}
    named = (
        stdin_lines, stdin_and_files, multi_file_ingest, dry_run_summary, default_top_values, field_overrides, fields_at_once, query_values, query_errors, views_cleared, tab_counts,
        zoomed, bookmarks_restored, next_bookmarks, column_limits, live_ingest, rotated_file, live_histogram,
    )
    return found | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    first = f"{Q.R}, m AS (SELECT line_id FROM r WHERE severity = 5 ORDER BY line_id LIMIT 20)"
    errors = ", ".join(f"('{q}', '{e}')" for q, e in ERRORS.items())
    halves = "row_number() OVER (ORDER BY line_id % 2, line_id) - 1 AS line_id"
    return dict.fromkeys((*FILES, "stdin_lines"), _SHOWN_SQL) | {f"fmt_{n}_malformed": _malformed_sql(n) for n in MALFORMED} | {
        "stdin_and_files": "SELECT '`-` cannot be combined with files' AS message",
        "multi_file_ingest": _INGEST_SQL,
        "dry_run_summary": _SUMMARY_SQL,
        "default_top_values": Q._top_sql("replace(props, ' ', '')", 8),
        "field_overrides": f"{Q.R} SELECT line_id, epoch_us(ts) AS ts_micros, CAST(severity AS INTEGER) AS severity, 'x' AS ts, 'fatal' AS level, false AS bad_ts FROM r",
        "fields_at_once": f"{Q.R} SELECT line_id, user AS u, logger AS l, props AS p FROM r",
        "query_values": f"{Q.R} SELECT line_id, " + ", ".join(f"({sql}) AS {c}" for c, (_, sql) in VALUES.items()) + " FROM r",
        "query_errors": f"SELECT * FROM (VALUES {errors}) t(query, message)",
        "views_cleared": f"{Q.R} SELECT count(*) AS cleared, count(*) FILTER (WHERE severity IN (2, 5) AND logger IS NOT NULL) AS blanked, count(*) FILTER (WHERE severity = 5 AND logger IS NOT NULL) AS kept FROM r",
        "tab_counts": f'{Q.R} SELECT count(*) AS "All", count(*) FILTER (WHERE severity >= 5) AS "Error", count(*) FILTER (WHERE severity = 4) AS "Warn", count(*) FILTER (WHERE severity = 3) AS "Info", count(*) FILTER (WHERE severity IN (1, 2)) AS "Debug" FROM r',
        "zoomed": _ZOOM_SQL,
        "bookmarks_restored": f"{first} SELECT line_id FROM m ORDER BY line_id LIMIT 10",
        "next_bookmarks": f"{first} SELECT line_id AS cursor, coalesce(lead(line_id) OVER (ORDER BY line_id), min(line_id) OVER ()) AS next FROM m",
        "column_limits": "SELECT CAST(a.i AS INTEGER) AS cap, CAST(b.i AS INTEGER) AS asked, CAST(greatest(0, least(a.i, b.i + 1) - 1) AS INTEGER) AS columns FROM range(6) a(i), range(6) b(i)",
        "live_ingest": f"{N} SELECT k AS line_id, ts_micros, CAST(severity AS INTEGER) AS severity, user, count(*) OVER () AS ingested FROM n",
        "rotated_file": f"{Q.R} SELECT {halves}, ts_micros, user FROM r",
        "live_histogram": _LIVE_SQL,
    }
