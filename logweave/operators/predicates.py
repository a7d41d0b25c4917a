"""Predicates over records. All are two-valued: a missing field or an untimed record never matches a leaf, so NOT does."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.record import FATAL
from logweave.functions.regex import checked, match_bytes

#: Gives a record's field as text, or null.
Project = Callable[[str], Column]
COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


class Predicate:
    """A condition on a record; ``column`` is never null."""

    def column(self, project: Project) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class RawRegex(Predicate):
    """Unanchored match over the whole raw line."""

    pattern: str

    def column(self, project: Project) -> Column:
        raw = F.col("raw")
        hit = match_bytes(raw, self.pattern) if self.pattern.startswith("(?-u)") else raw.rlike(checked(self.pattern).pattern)
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class FieldEquals(Predicate):
    """The field is there and equal, as text, case-sensitively."""

    field: str
    value: str

    def column(self, project: Project) -> Column:
        return F.coalesce(project(self.field) == F.lit(self.value), F.lit(False))


@dataclass(frozen=True)
class FieldRegex(Predicate):
    """Unanchored match on a field."""

    field: str
    pattern: str

    def column(self, project: Project) -> Column:
        return F.coalesce(project(self.field).rlike(checked(self.pattern).pattern), F.lit(False))


@dataclass(frozen=True)
class TimeRange(Predicate):
    """The record's time compared with a bound in microseconds."""

    op: str
    micros: int

    def column(self, project: Project) -> Column:
        return F.coalesce(COMPARE[self.op](F.col("ts_micros"), F.lit(self.micros)), F.lit(False))


@dataclass(frozen=True)
class SeverityIn(Predicate):
    """The severity is one of a set of codes."""

    levels: tuple[int, ...]

    def column(self, project: Project) -> Column:
        return F.col("severity").isin(*self.levels) if self.levels else F.lit(False)


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def column(self, project: Project) -> Column:
        return ~self.inner.column(project)


@dataclass(frozen=True)
class And(Predicate):
    """All of the parts; true without any."""

    parts: tuple[Predicate, ...]

    def column(self, project: Project) -> Column:
        return reduce(operator.and_, (p.column(project) for p in self.parts)) if self.parts else F.lit(True)


@dataclass(frozen=True)
class Or(Predicate):
    """Any of the parts; false without any."""

    parts: tuple[Predicate, ...]

    def column(self, project: Project) -> Column:
        return reduce(operator.or_, (p.column(project) for p in self.parts)) if self.parts else F.lit(False)


def minimum_and_above(levels: Iterable[int]) -> tuple[int, ...]:
    """Every severity from the least given one up to fatal."""
    given = tuple(levels)
    return tuple(range(min(given), FATAL + 1)) if given else ()


#: What the number keys choose; 0 clears. Fixed values.
PRESETS = {0: (), 1: (5, 6), 2: (4,), 3: (3,), 4: (2, 1)}


def field_filter(text: str) -> FieldEquals:
    """``name=value`` as typed: cut at the first ``=``, blanks around both sides dropped, the value may be empty."""
    name, sep, value = text.partition("=")
    if not sep or not name.strip():
        raise ValueError("expected field=value")
    return FieldEquals(name.strip(), value.strip())
