"""EDN records: an Arrow function cuts a line into tokens by one pattern and reads the top-level map by bracket depth."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from logweave.functions.record import SPELLED, UNKNOWN, literal_micros

#: Blanks and commas separate; a tag says how to read what follows it, which is not needed here.
_TOKEN = re.compile(
    r"""(?P<open>[{(\[]) | (?P<close>[})\]]) | (?P<tag>\#[^ \t\n\r,{}()\[\]]*)
      | "(?P<string>(?:[^"\\]|\\.|\\\Z)*)"? | :(?P<keyword>[^ \t\n\r,{}()\[\]]*) | (?P<bare>[^ \t\n\r,{}()\[\]"\#:][^ \t\n\r,{}()\[\]]*)""",
    re.VERBOSE | re.DOTALL | re.ASCII,
)
_ESCAPE = re.compile(r'\\(["\\])')


def entries(line: str) -> Iterator[tuple[str | None, str | None]]:
    """(name, text) of the entries of a line's map, in order.

    Keys that are keywords or strings without escapes have a name, less its namespace; nested values have no text.
    """
    tokens = _TOKEN.finditer(line)
    if (head := next(tokens, None)) is None or head["open"] != "{":
        return
    depth, name, at_value = 1, None, False
    for token in tokens:
        kind, text = token.lastgroup, token[token.lastgroup]
        if kind == "close":
            depth -= 1
            if depth == 0:
                return
        if kind == "open":
            depth += 1
        if kind in ("close", "tag") or depth > 1 + (kind == "open"):
            continue
        if not at_value:
            named = kind == "keyword" or kind == "string" and not _ESCAPE.search(text)
            name = text.rpartition("/")[2] if named else None
        else:
            yield name, None if kind == "open" else _ESCAPE.sub(r"\1", text) if kind == "string" else text
        at_value = not at_value


def read_line(line: str, time_field: str, level_field: str, wanted: Sequence[str] = ()) -> tuple[int | None, int, bool, bool, list[str | None]]:
    """(ts_micros, severity, bad_ts, bad_line, texts of ``wanted``): the last of repeated times and levels counts, the first of wanted fields."""
    micros, level, times, any_entry = None, None, False, False
    found: dict[str, str | None] = {}
    for name, text in entries(line):
        any_entry = True
        if name == time_field and text is not None:
            read, times = literal_micros(text), True
            micros = micros if read is None else read
        elif name == level_field:
            level = text
        if name is not None:
            found.setdefault(name, text)
    return micros, SPELLED.get(level, UNKNOWN), times and micros is None, not any_entry, [found.get(k) for k in wanted]


def parse_edn(raw: Column, time_field: str, level_field: str, wanted: Sequence[str] = ()) -> Column:
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


def project_edn(raw: Column, key: str) -> Column:
    """The text of the first value under the name."""
    return parse_edn(raw, "", "", (key,))["texts"][0]
