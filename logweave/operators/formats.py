"""The eleven line formats: time and severity, fields by name, and which lines continue a record.

Every format is a ``LineFormat``: ``parse`` gives ts_micros (null: untimed), severity, timed (the line has a
time, readable or not) and bad_line (the line is not of the format); ``project`` a field's text or
null. All are built-in expressions except EDN and the exact JSON mode. User formats join
through ``register_format``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import edn, exact_json
from logweave.functions.record import DEBUG, ERROR, FATAL, INFO, UNKNOWN, WARN, padded_micros, rfc3339_micros, severity_name, severity_of
from logweave.functions.regex import Translated, all_groups, checked

BLANKS = " \t\n\f\r"
#: Syslog and journal priorities 0 to 7. Fixed values.
PRIORITIES = (FATAL, FATAL, FATAL, ERROR, WARN, INFO, INFO, DEBUG)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@dataclass(frozen=True)
class Parsed:
    """Columns of a record; any of the flags may be left out."""

    ts_micros: Column
    severity: Column
    timed: Column
    bad_line: Column


@dataclass(frozen=True)
class SourceSpec:
    """How the lines of a source are read: format, renamed fields, header of CSV/TSV, pattern of the regex format, JSON mode."""

    format: str = "ndjson"
    time_field: str = "ts"
    level_field: str = "level"
    header: tuple[str, ...] = ()
    pattern: str | None = None
    exact: bool = False

    def line_format(self) -> LineFormat:
        return FORMATS[self.format](self)


class LineFormat:
    """A format over column ``raw``."""

    def __init__(self, spec: SourceSpec):
        self.spec = spec
        self.raw = F.col("raw")
        #: Fields that ``line`` holds besides time and level, where it is the column of ``held``.
        self.keys: tuple[str, ...] = ()
        self.line = self.read()

    def read(self, keys: Sequence[str] = ()) -> Column | None:
        """What one reading of a line gives to ``parse`` and ``project`` (of ``keys``); None if they read the line itself."""
        return None

    def held(self, lines: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, LineFormat]:
        """``lines`` with ``read`` as column ``__line``, computed once a line, and the format that takes it from there."""
        line = self.read(keys)
        if line is None:
            return lines, self
        made = copy(self)
        made.line, made.keys = F.col("__line"), tuple(keys)
        return lines.withColumn("__line", line), made

    def parse(self) -> Parsed:
        raise NotImplementedError

    def project(self, key: str) -> Column:
        raise NotImplementedError

    def continues(self) -> Column:
        """Whether a line belongs to the record before it."""
        return F.lit(False)

    @property
    def folds(self) -> bool:
        return type(self).continues is not LineFormat.continues


FORMATS: dict[str, Callable[[SourceSpec], LineFormat]] = {}
#: Other names of formats. Fixed values.
ALIASES = {"log4j": "logback", "java": "logback", "journal": "journalctl", "systemd": "journalctl"}


def register_format(name: str, make: Callable[[SourceSpec], LineFormat]) -> None:
    FORMATS[name] = make


def format_name(name: str) -> str:
    """Canonical name; unknown ones are refused."""
    known = ALIASES.get(name.lower(), name.lower())
    if known not in FORMATS:
        raise ValueError(f"unknown --format `{name}`")
    return known


def _json_path(key: str) -> str:
    return f"$['{key}']"


def _priority(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, PRIORITIES)), code.cast("int")), F.lit(UNKNOWN)).cast("tinyint")


class Ndjson(LineFormat):
    """A JSON object a line. ``exact`` keeps the source text of values; otherwise the JVM's JSON functions are used."""

    def read(self, keys: Sequence[str] = ()) -> Column:
        if self.spec.exact:
            return exact_json.parse_json(self.raw, self.spec.time_field, self.spec.level_field, keys)
        quoted = lambda name: "`" + name.replace("`", "``") + "`"
        fields = dict.fromkeys((self.spec.time_field, self.spec.level_field))
        shape = ", ".join([*(f"{quoted(f)} string" for f in fields), "`__bad` string"])
        return F.from_json(F.when(self._shaped, self.raw), shape, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})

    @property
    def _shaped(self) -> Column:
        blank = F.lit(" \t\r\n")
        return F.ltrim(self.raw, blank).startswith("{") & F.rtrim(self.raw, blank).endswith("}")

    def parse(self) -> Parsed:
        got = self.line
        if self.spec.exact:
            return Parsed(got["ts_micros"], got["severity"], got["bad_ts"], got["bad_line"])
        whole = got.isNotNull() & got["__bad"].isNull()
        ts = F.when(whole, got.getField(self.spec.time_field))
        micros = rfc3339_micros(ts)
        return Parsed(micros, severity_of(F.when(whole, got.getField(self.spec.level_field))), ts.isNotNull(), ~whole)

    def _get(self, key: str) -> Column:
        if "'" in key:
            return exact_json.project_json(self.raw, key)
        return F.get_json_object(self.raw, _json_path(key))

    def project(self, key: str) -> Column:
        if self.spec.exact and key in self.keys:
            return self.line["texts"][self.keys.index(key)]
        if self.spec.exact or "'" in key:
            return exact_json.project_json(self.raw, key)
        found = self._get(key)
        # Keys are only looked for where there is no value, which may be a null.
        return F.when(self._shaped, F.coalesce(found, F.when(F.array_contains(F.json_object_keys(self.raw), key), "null")))


class Logfmt(LineFormat):
    """``key=value`` pairs; of repeated keys the last gives time and level, the first is projected."""

    TOKEN = r'(?s)[^= \t]+(?:=(?:"(?:[^"\\]|\\.|\\$)*(?:"|$)|[^ \t]*))?'

    def read(self, keys: Sequence[str] = ()) -> Column:
        return F.regexp_extract_all(self.raw, F.lit(self.TOKEN), F.lit(0))

    def _values(self, key: str) -> Column:
        tokens = F.filter(self.line, lambda t: (t == key) | t.startswith(f"{key}="))
        bare = F.transform(tokens, lambda t: F.substring(t, F.lit(len(key) + 2), F.length(t)))
        return F.transform(bare, lambda v: F.when(v.startswith('"'), F.regexp_replace(F.regexp_replace(v, r'(?s)^"((?:[^"\\]|\\.|\\$)*)"?$', "$1"), r'\\(["\\])', "$1")).otherwise(v))

    def parse(self) -> Parsed:
        times, levels = self._values(self.spec.time_field), self._values(self.spec.level_field)
        read = F.filter(F.transform(times, rfc3339_micros), lambda t: t.isNotNull())
        micros = F.try_element_at(read, F.lit(-1))
        paired = self.raw.rlike(r"[^= \t]")
        return Parsed(micros, severity_of(F.try_element_at(levels, F.lit(-1))), F.size(times) > 0, ~paired)

    def project(self, key: str) -> Column:
        return F.get(self._values(key), F.lit(0))

    def continues(self) -> Column:
        return self.raw.rlike(r"^[ \t]")


class Edn(LineFormat):
    """EDN maps; namespaces of keys do not count, tags are seen through, nested values have no text."""

    def read(self, keys: Sequence[str] = ()) -> Column:
        return edn.parse_edn(self.raw, self.spec.time_field, self.spec.level_field, keys)

    def parse(self) -> Parsed:
        return Parsed(self.line["ts_micros"], self.line["severity"], self.line["bad_ts"], self.line["bad_line"])

    def project(self, key: str) -> Column:
        return self.line["texts"][self.keys.index(key)] if key in self.keys else edn.project_edn(self.raw, key)

    def continues(self) -> Column:
        return self.raw.rlike(r"^[ \t]")


def _spaced_time(text: Column) -> Column:
    """Micros of ``YYYY-MM-DD HH:MM:SS[.,]ddd``, 19 to 31 bytes."""
    iso = F.concat(F.substring(text, 1, 10), F.lit("T"), F.translate(F.substring(text, F.lit(12), F.length(text)), ",", "."), F.lit("Z"))
    return F.when(F.octet_length(text).between(19, 31) & (F.substring(text, 11, 1) == " "), rfc3339_micros(iso))


class PythonLogging(LineFormat):
    """``time - logger - LEVEL - message``"""

    def read(self, keys: Sequence[str] = ()) -> Column:
        return F.split(self.raw, " - ", 4)

    def _part(self, i: int) -> Column:
        return F.get(self.line, F.lit(i))

    def parse(self) -> Parsed:
        split, micros = self.raw.contains(" - "), _spaced_time(self._part(0))
        level = F.btrim(self._part(2), F.lit(BLANKS))
        return Parsed(F.when(split, micros), F.when(micros.isNotNull(), severity_of(level)).otherwise(F.lit(UNKNOWN).cast("tinyint")), split, ~split)

    def project(self, key: str) -> Column:
        third = self._part(2).isNotNull()
        if key == "ts":
            return F.when(self.raw.contains(" - "), self._part(0))
        if key == "msg":
            return F.when(third, F.coalesce(F.btrim(self._part(3), F.lit(BLANKS)), F.lit("")))
        at = {"logger": 1, "level": 2}.get(key)
        return F.lit(None).cast("string") if at is None else F.when(third, F.btrim(self._part(at), F.lit(BLANKS)))

    def continues(self) -> Column:
        return (self.raw != "") & ~self.raw.rlike("^[0-9]")


class Matched(LineFormat):
    """A format of one anchored pattern: its groups are at their numbers in ``line``, which has a single element if there is no match."""

    HEAD: str
    GROUPS: int

    def read(self, keys: Sequence[str] = ()) -> Column:
        return all_groups(self.raw, self.HEAD, self.GROUPS)

    def _group(self, i: int) -> Column:
        return F.get(self.line, F.lit(i))

    @property
    def _fits(self) -> Column:
        return F.size(self.line) > 1


class Syslog(Matched):
    """RFC 5424."""

    HEAD = r"(?s)^<([0-9]{1,10})>[0-9]+ ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+)(?:$| (?:$|(?:-(?= |$)|((?:\[(?:[^\]\\]|\\.)*\])+)) ?(.*)$))"
    FIELDS = {"host": 3, "app": 4, "procid": 5, "msgid": 6}

    GROUPS = 8

    @property
    def _fits(self) -> Column:
        return (F.size(self.line) > 1) & (self._group(1).try_cast("bigint") < 2**32)

    @property
    def _severity(self) -> Column:
        return _priority(self._group(1).try_cast("bigint").bitwiseAND(F.lit(7)))

    def parse(self) -> Parsed:
        stamp = self._group(2)
        micros = F.when(self._fits & (stamp != "-"), rfc3339_micros(stamp))
        return Parsed(micros, F.when(self._fits, self._severity).otherwise(F.lit(UNKNOWN).cast("tinyint")), self._fits & (stamp != "-"), ~self._fits)

    def project(self, key: str) -> Column:
        if key in self.FIELDS or key == "ts":
            out = F.nullif(self._group(self.FIELDS.get(key, 2)), F.lit("-"))
        elif key == "msg":
            out = self._group(8)
        elif key == "level":
            out = severity_name(self._severity)
        else:
            name, dot, wanted = key.partition(".")
            blocks = F.regexp_extract_all(self._group(7), F.lit(r"(?s)\[((?:[^\]\\]|\\.)*)\]"), F.lit(1))
            block = F.get(F.filter(blocks, lambda b: (b == name) | b.startswith(f"{name} ")), F.lit(0))
            if dot:
                params = F.regexp_extract_all(block, F.lit(r'(?s)[^= \]"]+="(?:[^"\\]|\\.)*"'), F.lit(0))
                param = F.get(F.filter(params, lambda p: p.startswith(f'{wanted}="')), F.lit(0))
                out = F.regexp_replace(F.substring(param, F.lit(len(wanted) + 3), F.length(param) - len(wanted) - 3), r"(?s)\\(.)", "$1")
            else:
                out = F.when(block.isNotNull(), "")
        return F.when(self._fits, out)

    def continues(self) -> Column:
        return (self.raw != "") & ~self.raw.startswith("<")


class Delimited(LineFormat):
    """CSV and TSV: fields by header name, or ``_N`` from 1. The header line is a record of its own, untimed."""

    @property
    def fields(self) -> Column:
        return self.line

    def read(self, keys: Sequence[str] = ()) -> Column:
        d = "\t" if self.spec.format == "tsv" else ","
        tokens = F.regexp_extract_all(self.raw, F.lit(f'(?s)"(?:[^"]|"")*(?:"|$){d}?|[^{d}"][^{d}]*{d}?|{d}'), F.lit(0))
        value = lambda t: F.when(t.startswith('"'), F.regexp_replace(F.regexp_replace(t, f'(?s)^"((?:[^"]|"")*)(?:"{d}?)?$', "$1"), '""', '"')).otherwise(F.regexp_replace(t, f"{d}$", ""))
        last = F.try_element_at(tokens, F.lit(-1))
        open_end = F.coalesce(last.endswith(d) & ~last.rlike('(?s)^"(?:[^"]|"")*$'), F.lit(True))
        return F.concat(F.transform(tokens, value), F.when(open_end, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))

    def _named(self, name: str) -> Column:
        return F.get(self.fields, F.lit(self.spec.header.index(name))) if name in self.spec.header else F.lit(None).cast("string")

    def parse(self) -> Parsed:
        ts = self._named(self.spec.time_field)
        micros = rfc3339_micros(ts)
        return Parsed(micros, severity_of(self._named(self.spec.level_field)), F.coalesce(ts != "", F.lit(False)), F.lit(False))

    def project(self, key: str) -> Column:
        if key not in self.spec.header and key.startswith("_") and key[1:].isdigit() and int(key[1:]) >= 1:
            return F.get(self.fields, F.lit(int(key[1:]) - 1))
        return self._named(key)


class Access(Matched):
    """Common and combined access logs; the severity follows the status."""

    QUOTED = r'"((?:[^"\\]|\\.)*)"'
    HEAD = rf'(?s)^([^ ]+) ([^ ]+) ([^ ]+) \[([^\]]*)\] ?{QUOTED} ?([^ ]++) ?+([^ ]*+) ?+(?:("(?:[^"\\]|\\.)*") ?+(?:("(?:[^"\\]|\\.)*")|(?!"))|(?!"))'
    FIELDS = {"ip": 1, "host": 1, "logname": 2, "user": 3, "status": 6, "bytes": 7}

    GROUPS = 9

    @property
    def _request(self) -> Column:
        return F.regexp_replace(self._group(5), r"(?s)\\(.)", "$1")

    @property
    def _severity(self) -> Column:
        s = self._group(6)
        kind = F.when(F.octet_length(s) == 3, F.substring(s, 1, 1))
        return F.when(kind == "5", ERROR).when(kind == "4", WARN).when(kind.isin("2", "3"), INFO).otherwise(UNKNOWN).cast("tinyint")

    def _time(self) -> Column:
        t = self._group(4)
        month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(t, 4, 3)).cast("string"), 2, "0")
        shaped = t.rlike(r"^../[A-Z][a-z]{2}/....:..:..:.. [+-]....") & (month != "00")
        iso = F.concat(F.substring(t, 8, 4), F.lit("-"), month, F.lit("-"), F.substring(t, 1, 2), F.lit("T"), F.substring(t, 13, 8), F.substring(t, 22, 3), F.lit(":"), F.substring(t, 25, 2))
        return F.when(shaped, rfc3339_micros(iso))

    def parse(self) -> Parsed:
        fits, micros = self._fits, self._time()
        return Parsed(F.when(fits, micros), F.when(fits, self._severity).otherwise(F.lit(UNKNOWN).cast("tinyint")), fits, ~fits)

    def project(self, key: str) -> Column:
        unescaped = lambda c: F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), r"(?s)\\(.)", "$1")
        if key in self.FIELDS:
            out = self._group(self.FIELDS[key])
            out = F.nullif(out, F.lit("-")) if key in ("logname", "user", "bytes") else out
        elif key == "request":
            out = self._request
        elif key in ("method", "uri", "protocol"):
            parts = F.split(self._request, " ", 3)
            out = F.when(F.size(parts) == 3, F.get(parts, F.lit(("method", "uri", "protocol").index(key))))
        elif key in ("referer", "user_agent"):
            quoted = self._group(8 if key == "referer" else 9)
            out = F.when(quoted != "", unescaped(quoted))
        elif key == "level":
            out = severity_name(self._severity)
        else:
            return F.lit(None).cast("string")
        return F.when(self._fits, out)


class Logback(Matched):
    """Logback and Log4j 2 with or without a thread."""

    HEAD = r"(?s)^(.{4}-.{2}-.{2} .{8}(?:[.,][0-9]*)?) ([A-Za-z]++) *+(?:\[([^\]]*)\] *|(?!\[))(.*)$"

    GROUPS = 4

    def parse(self) -> Parsed:
        fits, micros = self._fits, _spaced_time(self._group(1))
        return Parsed(F.when(fits, micros), F.when(fits, severity_of(self._group(2))).otherwise(F.lit(UNKNOWN).cast("tinyint")), fits, ~fits)

    def project(self, key: str) -> Column:
        tail = self._group(4)
        parts = F.split(tail, " - ", 2)
        if key == "msg":
            out = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(tail)
        elif key == "logger":
            out = F.nullif(F.when(F.size(parts) == 2, F.btrim(F.get(parts, F.lit(0)), F.lit(BLANKS))), F.lit(""))
        elif key in ("ts", "level", "thread"):
            out = F.nullif(self._group({"ts": 1, "level": 2, "thread": 3}[key]), F.lit(""))
        else:
            return F.lit(None).cast("string")
        return F.when(self._fits, out)

    def continues(self) -> Column:
        return (self.raw != "") & ~self.raw.rlike("^[0-9]")


class Journalctl(Ndjson):
    """JSON as the systemd journal exports it."""

    FIELDS = {"msg": "MESSAGE", "host": "_HOSTNAME", "unit": "_SYSTEMD_UNIT", "ident": "SYSLOG_IDENTIFIER"}

    def read(self, keys: Sequence[str] = ()) -> None:
        return None

    @property
    def _severity(self) -> Column:
        p = super().project("PRIORITY")
        return F.when(p.rlike("^[0-7]$"), _priority(p.try_cast("int"))).otherwise(F.lit(UNKNOWN).cast("tinyint"))

    def parse(self) -> Parsed:
        stamp = super().project("__REALTIME_TIMESTAMP")
        micros = F.when(stamp.rlike(r"^[+-]?[0-9]+$"), stamp.try_cast("bigint"))
        return Parsed(micros, self._severity, stamp.isNotNull(), F.lit(False))

    def project(self, key: str) -> Column:
        if key == "level":
            return F.when(super().project("PRIORITY").isNotNull(), severity_name(self._severity))
        return super().project(self.FIELDS.get(key, key))


class Pattern(LineFormat):
    """A pattern with named groups; ``ts`` and ``level`` are the time and the level unless renamed."""

    def __init__(self, spec: SourceSpec):
        if not spec.pattern:
            raise ValueError("--format=regex needs --pattern")
        self.made: Translated = checked(spec.pattern)
        super().__init__(spec)

    def read(self, keys: Sequence[str] = ()) -> Column:
        """The groups of the first match anywhere in the line: its rest on both sides is matched along."""
        return all_groups(self.raw, rf"(?s)\A(?:.*?)(?-s:{self.made.pattern})(?:.*)\z", self.made.count)

    def _group(self, name: str) -> Column:
        return F.get(self.line, F.lit(self.made.groups[name])) if name in self.made.groups else F.lit(None).cast("string")

    def parse(self) -> Parsed:
        fits, stamp = F.size(self.line) > 1, self._group(self.spec.time_field)
        micros = padded_micros(stamp)
        return Parsed(micros, severity_of(self._group(self.spec.level_field)), fits & stamp.isNotNull(), ~fits)

    def project(self, key: str) -> Column:
        if key == self.spec.level_field == "level":
            level = self._group(key)
            code = severity_of(level)
            return F.when(code == UNKNOWN, level).otherwise(severity_name(code))
        return self._group(key)


for _name, _make in {"ndjson": Ndjson, "logfmt": Logfmt, "edn": Edn, "python": PythonLogging, "syslog": Syslog, "csv": Delimited, "tsv": Delimited, "access": Access, "logback": Logback, "journalctl": Journalctl, "regex": Pattern}.items():
    register_format(_name, _make)


def project_any(specs: dict[int, SourceSpec], key: str) -> Column:
    """The field under each source's own format; one format for all needs no source test."""
    if len(set(specs.values())) == 1:
        return next(iter(specs.values())).line_format().project(key)
    return reduce(lambda out, s: F.when(F.col("source_id") == s[0], s[1].line_format().project(key)).otherwise(out), specs.items(), F.lit(None).cast("string"))
