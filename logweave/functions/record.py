"""The record table's columns: severities, timestamps and their text forms, as column expressions and for literals."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, TRACE, DEBUG, INFO, WARN, ERROR, FATAL = range(7)
#: Names by code; 0 is shown as "?". Fixed values.
NAMES = ("?", "trace", "debug", "info", "warn", "error", "fatal")
#: Level texts that are recognised, in these three casings only. Fixed values.
LEVELS = {"trace": TRACE, "debug": DEBUG, "info": INFO, "warn": WARN, "warning": WARN, "error": ERROR, "fatal": FATAL}
SPELLED = {form: code for name, code in LEVELS.items() for form in (name, name.capitalize(), name.upper())}
#: What an untimed record counts as where an order over times is needed.
UNTIMED_ORDER = -(2**63)
MICROS = 1_000_000
_WHOLE_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{0,9})?(?:Z|[+-][0-9]{2}:[0-9]{2})"
RFC3339 = rf"^{_WHOLE_TIME}\z"
#: Text to append to a time of so many characters. Fixed values.
PADDING = {4: "-01-01T00:00:00Z", 7: "-01T00:00:00Z", 10: "T00:00:00Z", 13: ":00:00Z", 16: ":00Z", 19: "Z"}


def severity_of(text: Column) -> Column:
    """Code of a level text; unknown spellings, other casings and null are 0."""
    return reduce(lambda out, code: F.when(text.isin(*[s for s, c in SPELLED.items() if c == code]), code).otherwise(out), range(TRACE, FATAL + 1), F.lit(UNKNOWN)).cast("tinyint")


def severity_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, NAMES)), code.cast("int")), F.lit(NAMES[0]))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date; months and days beyond their range roll over."""
    year = F.when(m <= 2, y - 1).otherwise(y)
    of_era = F.pmod(year, F.lit(400))
    era = F.floor((year - of_era) / 400).cast("long")
    day = F.floor((153 * F.when(m > 2, m - 3).otherwise(m + 9) + 2) / 5) + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + day - 719468


def rfc3339_micros(text: Column) -> Column:
    """Microseconds since the epoch of a whole RFC 3339 text (``T`` or a space, ``Z`` or an offset), null if it is none.

    Fractions are padded or cut to six digits; more than nine digits are refused. Fields are
    not checked against their ranges.
    """
    # The JVM's parser reads all times whose fields are in range; the arithmetic for the others stays out of generated code.
    rolled = F.get(F.transform(F.array(text), _rolled_micros), F.lit(0))
    return F.when(text.rlike(RFC3339), F.coalesce(F.unix_micros(text.try_cast("timestamp")), rolled))


def _rolled_micros(text: Column) -> Column:
    """Micros of a text that fits RFC3339, fields taken as they are."""
    part = lambda at, n: F.substring(text, at, n).try_cast("bigint")
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]*)", 1), 1, 6), 6, "0").try_cast("bigint")
    offset = F.when(F.substring(text, -1, 1) != "Z", F.when(F.substring(text, -6, 1) == "-", -1).otherwise(1) * (F.substring(text, -5, 2).try_cast("bigint") * 60 + F.substring(text, -2, 2).try_cast("bigint"))).otherwise(0)
    seconds = days_from_civil(part(1, 4), part(6, 2), part(9, 2)) * 86400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2) - offset * 60
    return (seconds * MICROS + fraction).cast("bigint")


def literal_micros(text: str) -> int | None:
    """``rfc3339_micros`` of a plain string."""
    if not re.fullmatch(_WHOLE_TIME, text, re.ASCII):
        return None
    y, m, d, hh, mm, ss = (int(text[a:b]) for a, b in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    year = y - (m <= 2)
    era, of_era = divmod(year, 400)
    days = era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + (153 * (m - 3 if m > 2 else m + 9) + 2) // 5 + d - 1 - 719468
    rest = text[19:].rstrip("Z")
    fraction = rest.partition("+")[0].partition("-")[0].removeprefix(".")
    offset = 0 if text.endswith("Z") else (-1 if text[-6] == "-" else 1) * (int(text[-5:-3]) * 60 + int(text[-2:]))
    return (days * 86400 + hh * 3600 + mm * 60 + ss - offset * 60) * MICROS + int(fraction[:6].ljust(6, "0"))


def padded_time(text: str) -> int | None:
    """Microseconds of a time given down to the year, month, day, hour, minute or second."""
    return literal_micros(text + PADDING.get(len(text), ""))


def padded_micros(text: Column) -> Column:
    """``padded_time`` as an expression; blanks around are cut and a blank between date and time is allowed."""
    cut = F.btrim(text, F.lit(" \t\n\f\r"))
    cut = F.when(F.substring(cut, 11, 1) == " ", F.concat(F.substring(cut, 1, 10), F.lit("T"), F.substring(cut, 12, 64))).otherwise(cut)
    return rfc3339_micros(reduce(lambda out, n: F.when(F.length(cut) == n, F.concat(cut, F.lit(PADDING[n]))).otherwise(out), PADDING, cut))


def time_text(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffff`` in UTC, whatever the session's zone; a dash for untimed records and for 0."""
    within = F.pmod(micros, F.lit(86400 * MICROS))
    # A multiple of a day's length divides without a rest, so the quotient is exact.
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((micros - within) / F.lit(86400 * MICROS)).cast("int"))
    second = F.floor(within / MICROS).cast("int")
    clock = [F.floor(second / 3600), F.floor(second / 60) % 60, second % 60, within % MICROS]
    shown = F.format_string("%sT%02d:%02d:%02d.%06d", day.cast("string"), *(x.cast("int") for x in clock))
    return F.when(micros.isNull() | (micros == 0), "—").otherwise(shown)
