"""From numbered lines to the record table: source_id, line_id, ts_micros, severity, raw and the parse flags."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.formats import SourceSpec
from logweave.operators.order import fold_lines

COLUMNS = ["source_id", "line_id", "ts_micros", "severity", "raw", "bad_ts", "bad_line", "is_header"]


def parse_lines(lines: DataFrame, spec: SourceSpec, fold: bool = False, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Records (numbered seq in their source) of the lines (source_id, seq, raw) of one format.

    ``fields`` (column -> field) adds fields that the same reading of a line gives.
    """
    made = spec.line_format()
    if fold and made.folds:
        lines = fold_lines(lines, made.continues())
    wanted = fields or {}
    lines, made = made.held(lines, tuple(dict.fromkeys(wanted.values())))
    p = made.parse()
    # A column of its own, so that the time is read once for its value and its flag.
    lines, micros = lines.withColumn("__micros", p.ts_micros), F.col("__micros")
    header = F.col("seq") == 0 if spec.header else F.lit(False)
    return lines.select(
        "source_id", "seq", micros.alias("ts_micros"), p.severity.alias("severity"), "raw", F.coalesce(p.timed & micros.isNull(), F.lit(False)).alias("bad_ts"),
        F.coalesce(p.bad_line, F.lit(False)).alias("bad_line"), header.alias("is_header"), *(made.project(k).alias(c) for c, k in wanted.items()),
    )


def with_fields(records: DataFrame, spec: SourceSpec, fields: Mapping[str, str]) -> DataFrame:
    """``records`` of one format with fields (column -> field), from one reading of a line for all of them."""
    held, made = spec.line_format().held(records, tuple(dict.fromkeys(fields.values())))
    return held.select(*(F.col(c) for c in records.columns if c not in fields), *(made.project(k).alias(c) for c, k in fields.items()))


def parse_status(records: DataFrame) -> DataFrame:
    """One row: records, untimed, ts_parse_errors, line_parse_errors."""
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("ts_micros").isNull()).alias("untimed"), F.count_if("bad_ts").alias("ts_parse_errors"), F.count_if("bad_line").alias("line_parse_errors"))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

