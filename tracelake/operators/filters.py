"""Filter rules as Columns: one compiler for views, one for ingestion. They differ on case and nulls.

View rules compare as SQL does (case matters, null fields never pass a rule that excludes). Ingestion rules know eight
text fields and in / eq / neq, ignore case, and never match a null or unknown field.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = frozenset("duration_us cpu_time_us logical_reads physical_reads writes row_count session_id".split())
TEXT = frozenset("database_name login_name client_hostname client_app_name event_name event_class object_name statement_kind normalized_hash".split())
INGEST = frozenset("database_name login_name client_hostname client_app_name event_name event_class object_name sql_text_raw".split())


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: str | None = None
    values: tuple[str, ...] = field(default=())
    stage: str = "view"
    action: str = "keep"
    enabled: bool = True
    id: str = ""

    @property
    def wanted(self) -> tuple[str, ...]:
        return self.values or (() if self.value is None else (self.value,))


def like(column: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash is itself."""
    return column.like(pattern.replace("\\", "\\\\"))


def contains_text(column: Column, text: str) -> Column:
    """Case-blind search; % and _ in the text are wildcards."""
    return column.ilike(f"%{text}%".replace("\\", "\\\\"))


def _literal(name: str, value: str):
    return F.lit(value).cast("decimal(38,6)") if name in NUMERIC else F.lit(value)


def _matches(rule: Rule) -> Column | None:
    column = F.col(rule.field)
    wanted = [_literal(rule.field, v) for v in rule.wanted]
    if not wanted:
        return F.lit(False) if rule.op == "in" else None
    first = wanted[0]
    compare = {
        "in": lambda: column.isin(*wanted),
        "eq": lambda: column == first,
        "neq": lambda: column != first,
        "gt": lambda: column > first,
        "lt": lambda: column < first,
        "gte": lambda: column >= first,
        "lte": lambda: column <= first,
        "like": lambda: like(column.cast("string"), rule.wanted[0]),
    }
    return compare[rule.op]() if rule.op in compare else None


def view(rules: list[Rule]) -> Column:
    """All enabled view rules on known fields, joined by AND; true without any. Rules with unknown fields or operators don't count."""
    out = []
    for rule in rules:
        if rule.enabled and rule.stage == "view" and rule.field in NUMERIC | TEXT:
            found = _matches(rule)
            if found is not None:
                out.append(~found if rule.action == "exclude" else found)
    return reduce(lambda a, b: a & b, out, F.lit(True))


def ingest(rules: list[Rule]) -> Column:
    """Whether an event is kept: no excluding rule matches and every keeping rule does."""
    out = F.lit(True)
    for rule in rules:
        if not rule.enabled or rule.stage != "ingest":
            continue
        match: Column = F.lit(False)
        if rule.field in INGEST and rule.wanted:
            column, wanted = F.lower(F.col(rule.field)), [v.lower() for v in rule.wanted]
            match = {"in": column.isin(wanted), "eq": column == wanted[0], "neq": column != wanted[0]}.get(rule.op, match)
        match = F.coalesce(match, F.lit(False))
        out = out & (~match if rule.action == "exclude" else match)
    return out


def half_open(column: Column, start=None, end=None) -> Column:
    """start <= column < end, each end only where it is given."""
    out = F.lit(True)
    if start is not None:
        out = out & (column >= F.lit(start))
    return out if end is None else out & (column < F.lit(end))


def overlaps(start: Column, end: Column, window_from=None, window_to=None) -> Column:
    """Whether [start, end] meets the window; a missing end of the window reaches without bound."""
    out = F.lit(True)
    if window_to is not None:
        out = out & (start < F.lit(window_to))
    return out if window_from is None else out & (end > F.lit(window_from))
