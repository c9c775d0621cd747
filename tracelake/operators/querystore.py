"""Query history extracts: windows, shapes and conversions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import microseconds
from .filters import overlaps

#: Metrics of a runtime interval, and whether the source gives them in milliseconds.
METRICS = {
    "duration": True, "cpu_time": True, "logical_io_reads": False, "logical_io_writes": False, "physical_io_reads": False, "clr_time": True,
    "dop": False, "query_max_used_memory": False, "rowcount": False, "log_bytes_used": False, "tempdb_space_used": False,
}
#: Those that sources before version 14 lack.
RECENT = ("log_bytes_used", "tempdb_space_used")


def metric_columns() -> list[str]:
    return [f"{part}_{name}" for name in METRICS for part in ("avg", "min", "max", "last", "stdev")]


def has_recent(version: str | None) -> bool:
    """Whether a source of this version has the recent metrics: unknown ones are taken as new, odd ones as old."""
    if not version:
        return True
    major = version.split(".")[0]
    return major.isdigit() and int(major) >= 14


def parse_window(start: str | None = None, end: str | None = None, last: str | None = None, now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """The window of an import: from and to, or the last hours or days."""
    if last is not None:
        if start is not None or end is not None:
            raise ValueError("either a span or its ends")
        found = re.fullmatch(r"([0-9]+)([hd])", last.strip(), re.I)
        if not found or not int(found[1]):
            raise ValueError(f"no span: {last}")
        now = now or datetime.utcnow()
        return now - timedelta(**{"hours" if found[2].lower() == "h" else "days": int(found[1])}), now
    a, b = (None if x is None else datetime.fromisoformat(x) for x in (start, end))
    if a and b and a >= b:
        raise ValueError("the window ends before it begins")
    return a, b


def in_window(intervals: DataFrame, window_from=None, window_to=None) -> DataFrame:
    """The intervals that meet the window."""
    return intervals.where(overlaps(F.col("start_time"), F.col("end_time"), window_from, window_to))


def runtime_stats(runtime: DataFrame, intervals: DataFrame, window_from=None, window_to=None, version: str | None = None) -> DataFrame:
    """Runtime rows of the intervals that meet the window, times in whole microseconds, other metrics in whole numbers, deviations as they are."""
    rows = runtime.join(in_window(intervals, window_from, window_to).select("runtime_stats_interval_id", "start_time", "end_time"), "runtime_stats_interval_id")
    columns = []
    for name, milliseconds in METRICS.items():
        for part in ("avg", "min", "max", "last", "stdev"):
            column = f"{part}_{name}"
            there = column in rows.columns and (name not in RECENT or has_recent(version))
            value = F.col(column) if there else F.lit(None)
            if part == "stdev":
                value = value.cast("double") * 1000 if milliseconds else value.cast("double")
            else:
                value = microseconds(value) if milliseconds else value.cast("double").cast("bigint")
            columns.append(value.alias(column))
    own = [c for c in ("runtime_stats_id", "plan_id", "runtime_stats_interval_id", "start_time", "end_time", "execution_type", "execution_type_desc", "count_executions") if c in rows.columns]
    return rows.select(*own, *columns)


def wait_stats(waits: DataFrame, intervals: DataFrame, window_from=None, window_to=None) -> DataFrame:
    """Wait rows of the intervals that meet the window, waits in whole microseconds, the deviation as it is."""
    rows = waits.join(in_window(intervals, window_from, window_to), "runtime_stats_interval_id", "left_semi")
    names = [f"{part}_query_wait_time" for part in ("total", "avg", "min", "max", "last")]
    times = [microseconds(F.col(f"{n}_ms")).alias(f"{n}_us") for n in names]
    deviation = (F.col("stdev_query_wait_time_ms").cast("double") * 1000).alias("stdev_query_wait_time_us")
    return rows.select("wait_stats_id", "plan_id", "runtime_stats_interval_id", F.col("wait_category_desc").alias("wait_category"), F.col("execution_type_desc").alias("execution_type"), *times, deviation)


def plans_in_window(plans: DataFrame, runtime: DataFrame, intervals: DataFrame, window_from=None, window_to=None) -> DataFrame:
    """Plans that ran in the window; without a window all plans, whether they ran or not."""
    if window_from is None and window_to is None:
        return plans
    active = runtime.join(in_window(intervals, window_from, window_to), "runtime_stats_interval_id", "left_semi")
    return plans.join(active, "plan_id", "left_semi")


def queries_in_window(queries: DataFrame, plans: DataFrame, runtime: DataFrame, intervals: DataFrame, window_from=None, window_to=None) -> DataFrame:
    """Queries with a plan that ran in the window; without a window all."""
    if window_from is None and window_to is None:
        return queries
    return queries.join(plans_in_window(plans, runtime, intervals, window_from, window_to), "query_id", "left_semi")


def texts_in_window(texts: DataFrame, queries: DataFrame, plans: DataFrame, runtime: DataFrame, intervals: DataFrame, window_from=None, window_to=None) -> DataFrame:
    """Texts of queries that ran in the window: what was a chain of joins and a DISTINCT is a chain of semi joins."""
    if window_from is None and window_to is None:
        return texts
    return texts.join(queries_in_window(queries, plans, runtime, intervals, window_from, window_to), "query_text_id", "left_semi")
