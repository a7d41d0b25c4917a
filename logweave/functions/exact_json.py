"""Byte-exact JSON records: source text of values is kept (numbers as written, escapes unresolved, ``null`` as text)."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from logweave.functions.record import SPELLED, UNKNOWN, literal_micros

_WS = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
_STRICT = json.JSONDecoder(parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)), strict=True)


def raw_fields(line: str) -> dict[str, str] | None:
    """Top-level keys with the text of their values; None unless the line is one JSON object. The last of repeated keys counts."""
    at = _WS.match(line).end()
    if line[at : at + 1] != "{":
        return None
    out: dict[str, str] = {}
    at = _WS.match(line, at + 1).end()
    if line[at : at + 1] == "}":
        return out if _WS.fullmatch(line, at + 1) else None
    while True:
        key = _STRING.match(line, at)
        if key is None or "\\" in key[1]:  # keys are borrowed as written
            return None
        at = _WS.match(line, key.end()).end()
        if line[at : at + 1] != ":":
            return None
        start = _WS.match(line, at + 1).end()
        try:
            _, at = _STRICT.raw_decode(line, start)
        except ValueError:
            return None
        out[key[1]] = line[start:at]
        at = _WS.match(line, at).end()
        if line[at : at + 1] == "}":
            return out if _WS.fullmatch(line, at + 1) else None
        if line[at : at + 1] != ",":
            return None
        at = _WS.match(line, at + 1).end()


def unquoted(value: str) -> str:
    """Outer quotes dropped, nothing unescaped."""
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value


def read_line(line: str, time_field: str, level_field: str, wanted: Sequence[str] = ()) -> tuple[int | None, int, bool, bool, list[str | None]]:
    """(ts_micros, severity, bad_ts, bad_line, texts of ``wanted``) of a line, from one reading of it."""
    fields = raw_fields(line)
    if fields is None:
        return None, UNKNOWN, False, True, [None] * len(wanted)
    texts = [unquoted(fields[k]) if k in fields else None for k in wanted]
    ts, level = fields.get(time_field), fields.get(level_field)
    odd = [v for v in (ts, level) if v is not None and v != "null" and (v[0] != '"' or "\\" in v)]
    if odd and (time_field, level_field) == ("ts", "level"):
        return None, UNKNOWN, False, True, texts
    ts, level = (None if v is None or v == "null" or v in odd else unquoted(v) for v in (ts, level))
    micros = None if ts is None else literal_micros(ts)
    return micros, SPELLED.get(level, UNKNOWN), ts is not None and micros is None, False, texts


def parse_json(raw: Column, time_field: str, level_field: str, wanted: Sequence[str] = ()) -> Column:
    """struct(ts_micros, severity, bad_ts, bad_line, texts), texts in the order of ``wanted``: one pass a line for all."""
    types = (pa.int64(), pa.int8(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
    names = ("ts_micros", "severity", "bad_ts", "bad_line", "texts")
    wanted = tuple(wanted)

    @arrow_udf("struct<ts_micros:bigint,severity:tinyint,bad_ts:boolean,bad_line:boolean,texts:array<string>>")
    def parse(lines: pa.Array) -> pa.Array:
        columns = zip(*(read_line(t or "", time_field, level_field, wanted) for t in lines.to_pylist()), strict=True)
        made = [pa.array(c, t) for c, t in zip(columns, types, strict=False)] or [pa.array([], t) for t in types]
        return pa.StructArray.from_arrays(made, names)

    return parse(raw)


def project_json(raw: Column, key: str) -> Column:
    return parse_json(raw, "", "", (key,))["texts"][0]


def pretty_json(raw: Column) -> Column:
    """A JSON object indented, keys in order; null for other lines. Meant for the few rows on show."""

    def pretty(line: str | None) -> str | None:
        try:
            value = json.loads(line or "")
        except ValueError:
            return None
        return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) if isinstance(value, dict) else None

    @arrow_udf("string")
    def indent(lines: pa.Array) -> pa.Array:
        return pa.array([pretty(t) for t in lines.to_pylist()], pa.string())

    return indent(raw)
