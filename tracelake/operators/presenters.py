"""What a screen of the slowest statements shows and how it is driven, without the screen."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import workload
from .filters import Rule

SORTS = ("total", "p95", "max", "avg")
#: Columns by the names that a user chooses from, in the order of display.
COLUMNS = {"kind": "statement_kind", "signature": "normalized_sql", "count": "cnt", "avg": "avg_us", "p95": "p95_us", "max": "max_us", "total": "total_us"}


def chosen(catalog: list[str], wanted: list[str]) -> list[str]:
    """The catalog's columns that are wanted, in its order, whatever their case; all of them if none is wanted."""
    low = {w.lower() for w in wanted}
    return [c for c in catalog if c.lower() in low] if wanted else list(catalog)


@dataclass
class TopSlow:
    """The slowest statements of signed executions: sort order, text filter, rules and columns."""

    executions: DataFrame
    limit: int = 50
    sort: str = SORTS[0]
    text: str = ""
    rules: list[Rule] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)

    def next_sort(self) -> None:
        self.sort = SORTS[(SORTS.index(self.sort) + 1) % len(SORTS)]

    def set_sort(self, sort: str | None) -> None:
        """A saved order; what is no order changes nothing."""
        self.sort = sort if sort in SORTS else self.sort

    def load(self) -> DataFrame:
        return workload.top_statements(self.executions, self.limit, self.sort, self.rules, self.text or None)

    def shown(self) -> DataFrame:
        return self.load().select(*(COLUMNS[c] for c in chosen(list(COLUMNS), self.columns)))


@dataclass
class DrillDown:
    """One statement: its first executions, and its durations by value of a parameter."""

    executions: DataFrame
    parameters: DataFrame
    normalized_hash: str

    def occurrences(self, limit: int = 100) -> DataFrame:
        return workload.occurrences(self.executions, self.normalized_hash, limit)

    def impact(self, parameter: str) -> DataFrame:
        return workload.parameter_impact(self.executions, self.parameters, parameter, self.normalized_hash)
