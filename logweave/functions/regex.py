"""Patterns of the query language in the dialect of the JVM.

The language's patterns are those of a linear-time matcher: Unicode-aware classes, named groups
``(?P<name>…)``, ``$`` only at the very end, no look-around and no back-references.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


class PatternError(ValueError):
    """The pattern is not one of the language's."""


@dataclass(frozen=True)
class Translated:
    """A JVM pattern, the numbers of its named groups and the number of all groups."""

    pattern: str
    groups: dict[str, int]
    count: int


def translate(pattern: str) -> Translated:
    """Rewrite a pattern: named groups become plain ones, ``$`` the very end, classes Unicode-aware, ``.`` stops at ``\\n`` only."""
    out, groups, count = [], {}, 0
    i, in_class, multi = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise PatternError("trailing backslash")
            n = pattern[i + 1]
            if not in_class and (n.isdigit() and n != "0" or n == "k"):
                raise PatternError("back-references are not supported")
            if n in "ZGRQEX" or n == "h":
                raise PatternError(f"unrecognised escape \\{n}")
            out.append("\\z" if n == "z" and not in_class else c + n)
            i += 2
            continue
        if in_class:
            if c == "[":
                in_class += 1
            elif c == "]":
                in_class -= 1
            out.append("\\" + c if c == "&" and pattern[i + 1 : i + 2] != "&" else c)
            if c == "[" and pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            i += 1
            continue
        if c == "[":
            in_class = 1
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "(":
            if named := re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>", pattern[i:]):
                count += 1
                if named[1] in groups:
                    raise PatternError(f"duplicate group name {named[1]}")
                groups[named[1]] = count
                out.append("(")
                i += len(named[0])
                continue
            if re.match(r"\(\?(?:[=!]|<[=!]|>)", pattern[i:]):
                raise PatternError("look-around is not supported")
            if flags := re.match(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])", pattern[i:]):
                if "u" in (flags[2] or ""):
                    raise PatternError("byte patterns (?-u) need match_bytes")
                on, off = flags[1].replace("u", "").replace("R", ""), flags[2] or ""
                if set(on + off) - set("imsxU"):
                    raise PatternError(f"unrecognised flag in {flags[0]}")
                if "U" in on + off:
                    raise PatternError("swapped greediness is not supported")
                multi |= "m" in on
                inner = f"(?{on}{'-' + off if off else ''}{flags[3]}"
                out.append("" if inner == "(?)" else inner.replace("(?:", "(?:"))
                i += len(flags[0])
                continue
            count += 1
            out.append(c)
        elif c == "$":
            out.append("$" if multi else "\\z")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise PatternError("unclosed character class")
    return Translated("(?Ud)" + "".join(out), groups, count)


def checked(pattern: str) -> Translated:
    """``translate`` and, where a session runs, have the JVM compile the result, so that errors appear before any scan."""
    made = translate(pattern)
    if (spark := SparkSession.getActiveSession()) is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(made.pattern)
        except Exception as e:
            raise PatternError(str(getattr(e, "java_exception", e)).splitlines()[0]) from None
    else:
        try:
            re.compile(re.sub(r"\\z", r"\\Z", made.pattern.removeprefix("(?Ud)")))
        except re.error as e:
            raise PatternError(str(e)) from None
    return made


_MARK = "\u0001"


def all_groups(text: Column, pattern: str, groups: int) -> Column:
    """The groups of an anchored pattern at their numbers in one array, from one match; an array of one element where it does not match.

    The match is rewritten into its groups with a mark between them. Texts that hold the mark themselves are matched once a group.
    """
    rewritten = F.regexp_replace(text, pattern, _MARK + _MARK.join(f"${i}" for i in range(1, groups + 1)) + _MARK)
    apart = F.when(text.rlike(pattern), F.array(F.lit(""), *(F.regexp_extract(text, pattern, i) for i in range(1, groups + 1)))).otherwise(F.array(F.lit("")))
    return F.when(text.contains(_MARK), apart).otherwise(F.split(rewritten, _MARK, -1))


def match_bytes(raw: Column, pattern: str) -> Column:
    """Unanchored match of a byte pattern ``(?-u)…`` over the undecoded bytes, batch by batch."""
    compiled = re.compile(pattern.replace("(?-u)", "").encode("latin-1"))

    @arrow_udf("boolean")
    def found(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else compiled.search(v) is not None for v in column.to_pylist()], pa.bool_())

    return found(raw.cast("binary"))
