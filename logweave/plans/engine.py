"""The facade: open inputs as one record table, look at it through views, summarise, save, follow."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import aggregates, order, records
from logweave.operators.formats import SourceSpec, format_name, project_any
from logweave.operators.predicates import Predicate
from logweave.plans.dsl import compile_query
from logweave.plans.view import ViewSpec
from logweave.sources import files, sinks

SHOWN_COLUMNS = 8


@dataclass
class LogEngine:
    """A record table and how each of its sources is read."""

    records: DataFrame
    specs: dict[int, SourceSpec]

    @classmethod
    def open(cls, spark: SparkSession, paths: str | Sequence[str], format: str | None = None, pattern: str | None = None, time_field: str = "ts", level_field: str = "level", fold: str = "always", exact: bool = False, keep_cr: bool = False, cache: bool = True) -> LogEngine:
        """Read the files (``-``: standard input) into one record table; several are merged by time.

        ``format`` is guessed from the first file if not given; ``pattern`` implies the regex format.
        ``fold``: ``always`` joins continuation lines where the format has a rule, ``reference`` only for
        compressed, array and standard inputs of a single source, ``never`` not at all.
        """
        paths = [paths] if isinstance(paths, str) else list(paths) or ["-"]
        if "-" in paths and len(paths) > 1:
            raise ValueError("`-` cannot be combined with files")
        name = "regex" if pattern else format_name(format) if format else files.probe_format(spark, paths) or "ndjson"
        if name == "regex" and not pattern:
            raise ValueError("--format=regex needs --pattern")
        base = SourceSpec(name, time_field, level_field, (), pattern, exact)
        parts, specs = [], {}
        for i, path in enumerate(paths):
            lines, kind = files.open_lines(spark, path, i, keep_cr)
            spec = replace(base, format="ndjson") if kind == "array" else base
            spec = _with_header(spec, lines)
            folds = fold == "always" or fold == "reference" and kind != "plain" and len(paths) == 1
            parts.append(records.parse_lines(lines, spec, folds))
            specs[i] = spec
        return cls._of(parts, specs, cache)

    @classmethod
    def of_lines(cls, spark: SparkSession, lines: Iterable[str], spec: SourceSpec | None = None, fold: bool = True) -> LogEngine:
        """Records of lines in memory."""
        made = files.given_lines(spark, lines)
        spec = _with_header(spec or SourceSpec(), made)
        return cls._of([records.parse_lines(made, spec, fold)], {0: spec}, False)

    @classmethod
    def _of(cls, parts: list[DataFrame], specs: dict[int, SourceSpec], cache: bool) -> LogEngine:
        if len(parts) == 1:
            table = parts[0].withColumnRenamed("seq", "line_id")
        else:
            table = order.merge_by_time(records.union_sources(parts))
        table = table.select(*records.COLUMNS)
        return cls(table.persist() if cache else table, specs)

    def project(self, key: str) -> Column:
        """A field's text, or null, under each row's own format."""
        return project_any(self.specs, key)

    def view(self, spec: ViewSpec) -> DataFrame:
        return spec.apply(self.records, self.project)

    def scan(self, predicate: Predicate | str) -> DataFrame:
        """Records that match a predicate or a query text."""
        made = compile_query(predicate) if isinstance(predicate, str) else predicate
        return self.records.where(made.column(self.project))

    def histogram(self, spec: ViewSpec | None = None, bins: int = 60, window: tuple[int, int] | None = None) -> DataFrame:
        return aggregates.histogram(self.view(spec or ViewSpec()), bins, window)

    def stats(self, spec: ViewSpec | None = None) -> DataFrame:
        return aggregates.summary(self.view(spec or ViewSpec()))

    def top_values(self, field: str | None = None, spec: ViewSpec | None = None, n: int = SHOWN_COLUMNS) -> DataFrame | None:
        """Top values of a field; by default of the first automatic column."""
        field = field or next(iter(self.auto_columns(SHOWN_COLUMNS)), None)
        return None if field is None else aggregates.top_values(self.view(spec or ViewSpec()), self.project(field), n)

    def schema(self) -> DataFrame:
        return aggregates.schema_scan(self.records)

    def rescan_schema(self, spec: ViewSpec) -> DataFrame:
        return aggregates.middle_schema(self.view(spec))

    def auto_columns(self, most: int) -> list[str]:
        return aggregates.auto_columns(self.schema(), most)

    def less_mode(self) -> bool:
        """Neither times, severities nor fields are known for most rows: show plain text."""
        flags = aggregates.majority_flags(self.records).first()
        return not (flags["has_timestamps"] or flags["has_severity"] or self.schema().limit(1).count())

    def summary(self) -> str:
        """What a dry run prints."""
        s = records.parse_status(self.records).first()
        fields = self.schema().count()
        columns = json.dumps(self.auto_columns(SHOWN_COLUMNS), ensure_ascii=False)
        scanned = min(s["records"], aggregates.SCHEMA_ROWS)
        return (
            f"indexed {s['records']} records — untimed: {s['untimed']} (ts missing/bad: {max(0, s['untimed'] - s['ts_parse_errors'])}/{s['ts_parse_errors']}), json errors: {s['line_parse_errors']}\n"
            f"schema: {fields} fields scanned ({scanned} records in warmup), auto-columns: {columns}"
        )

    def save(self, spec: ViewSpec, path: str, single: bool = False) -> None:
        sinks.save_view(self.view(spec), path, single)

    def register(self, name: str = "records") -> None:
        """Make the table available to SQL."""
        self.records.createOrReplaceTempView(name)


def _with_header(spec: SourceSpec, lines: DataFrame) -> SourceSpec:
    """CSV and TSV take their header from the first line of the source."""
    if spec.format not in ("csv", "tsv"):
        return spec
    first = lines.where("seq = 0").select("raw").select(spec.line_format().fields.alias("f")).first()
    return replace(spec, header=tuple(first["f"]) if first else ())


def follow(spark: SparkSession, path: str, spec: SourceSpec | None = None, query: str | None = None, max_bytes: int = 8 << 20, part: tuple[dict, int | None] | None = None) -> DataFrame:
    """A streaming table of the records of one growing file, from its start, through rotation and truncation; or of one ``part`` of ``tail.cut``."""
    from logweave.streaming import tail

    spec = spec or SourceSpec()
    spark.dataSource.register(tail.TailSource)
    start, stop = (json.dumps(x) for x in part or (None, None))
    lines = spark.readStream.format("logtail").option("path", path).option("maxBytes", max_bytes).option("start", start).option("stop", stop).load()
    table = lines.select(F.lit(0).alias("source_id"), F.col("seq"), F.col("raw"))
    parsed = records.parse_lines(table, spec).withColumnRenamed("seq", "line_id").select(*records.COLUMNS)
    return parsed if query is None else parsed.where(compile_query(query).column(lambda k: project_any({0: spec}, k)))
