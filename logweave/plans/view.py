"""A view: filters over the record table, as an immutable description that becomes one condition."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from logweave.operators.predicates import PRESETS, And, FieldEquals, Predicate, Project, RawRegex, SeverityIn, TimeRange, field_filter, minimum_and_above
from logweave.plans.dsl import compile_query

TABS = ("All", "Error", "Warn", "Info", "Debug")


@dataclass(frozen=True)
class ViewSpec:
    """All parts hold together (AND). ``at_least`` widens the severities from their minimum up to fatal."""

    regex: str | None = None
    fields: tuple[FieldEquals, ...] = ()
    severities: tuple[int, ...] = ()
    at_least: bool = False
    query: str | None = None
    time_range: tuple[int, int] | None = None

    def with_field(self, text: str) -> ViewSpec:
        return replace(self, fields=(*self.fields, field_filter(text)))

    def with_query(self, text: str) -> ViewSpec:
        """Set the query; blank text clears it, an error leaves the old view in place."""
        text = text.strip()
        if text:
            compile_query(text)
        return replace(self, query=text or None)

    def with_preset(self, number: int) -> ViewSpec:
        return replace(self, severities=PRESETS[number])

    def toggle_at_least(self) -> ViewSpec:
        return replace(self, at_least=not self.at_least)

    def cleared(self) -> ViewSpec:
        return ViewSpec(at_least=self.at_least)

    def predicate(self) -> Predicate:
        """Cheap conditions come first; all are pure, so the result does not depend on it."""
        parts: list[Predicate] = []
        if self.severities:
            parts.append(SeverityIn(minimum_and_above(self.severities) if self.at_least else self.severities))
        if self.time_range is not None:
            parts += [TimeRange(">=", self.time_range[0]), TimeRange("<=", self.time_range[1])]
        parts += self.fields
        if self.query:
            parts.append(compile_query(self.query))
        if self.regex:
            parts.append(RawRegex(self.regex))
        return And(tuple(parts))

    def column(self, project: Project) -> Column:
        return self.predicate().column(project)

    def apply(self, records: DataFrame, project: Project) -> DataFrame:
        return records.where(self.column(project))


def tabs(has_severity: bool) -> dict[str, ViewSpec]:
    """One view for all records and, where severities are known, one for each preset."""
    return {name: ViewSpec(severities=PRESETS[i]) for i, name in enumerate(TABS if has_severity else TABS[:1])}
