"""Questions about captured statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import Rule, contains_text, view
from .quantiles import of_counts

SORTS = {"total": "total_us", "p95": "p95_us", "max": "max_us", "avg": "avg_us", "count": "cnt"}
DIMENSIONS = ("database_name", "login_name", "client_hostname", "client_app_name")


KEYS = ["normalized_hash", "statement_kind", "primary_table", "normalized_sql"]


def durations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cnt, avg_us, p95_us (exact, interpolated), max_us and total_us of the rows' durations.

    All comes from counts of the different durations of each key, made before anything is shuffled: a statement that a third
    of all rows ran is no large group."""
    counts = rows.groupBy(*keys, F.col("duration_us").alias("value")).agg(F.count("*").alias("n"))
    timed = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    # A quotient of whole numbers: sums of whole durations don't depend on the order of rows.
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("cnt"), (F.sum(F.col("value") * F.col("n")) / timed).alias("avg_us"), F.max("value").alias("max_us"), F.sum(F.col("value") * F.col("n")).alias("total_us"))
    found = of_counts(counts, keys, {"p95_us": 0.95}).select(*(F.col(k).alias(f"_{k}") for k in keys), "p95_us")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return sums.join(found, same, "left").select(*keys, "cnt", "avg_us", "p95_us", "max_us", "total_us")


def top_statements(executions: DataFrame, limit: int | None = 20, sort: str = "total", rules: list[Rule] = (), text: str | None = None) -> DataFrame:
    """Statements by fingerprint with count, mean, 95th percentile, greatest and summed durations, worst first.

    executions carry their signature columns. Unknown sorts fall back to the total. The text filter comes before the
    limit. Ties go to the lesser hash."""
    rows = executions.where(view(list(rules)))
    if text:
        rows = rows.where(contains_text(F.col("normalized_sql"), text))
    out = durations(rows, KEYS)
    order = F.col(SORTS.get(sort, "total_us"))
    return out.orderBy(order.desc_nulls_last(), "normalized_hash").limit(limit) if limit is not None else out


def top_frequent(executions: DataFrame, limit: int = 20, rules: list[Rule] = ()) -> DataFrame:
    return top_statements(executions, limit, "count", rules)


def occurrences(executions: DataFrame, normalized_hash: str, limit: int = 100) -> DataFrame:
    """The first executions of a statement; ties go to the lesser id."""
    return executions.where(F.col("normalized_hash") == normalized_hash).orderBy(F.col("captured_at").asc_nulls_last(), "execution_id").limit(limit)


def session_flow(executions: DataFrame, session_id: int, start, end) -> DataFrame:
    """What a session ran between two times, both included, in order."""
    return executions.where((F.col("session_id") == session_id) & F.col("captured_at").between(F.lit(start), F.lit(end))).orderBy(F.col("captured_at").asc_nulls_last(), "execution_id")


def parameter_impact(executions: DataFrame, parameters: DataFrame, name: str, normalized_hash: str | None = None) -> DataFrame:
    """Durations by value of a parameter, slowest mean first."""
    rows = executions if normalized_hash is None else executions.where(F.col("normalized_hash") == normalized_hash)
    joined = rows.select("execution_id", "duration_us").join(parameters.where(F.col("name") == name).select("execution_id", "value_text"), "execution_id")
    out = durations(joined, ["value_text"]).drop("total_us")
    return out.orderBy(F.col("avg_us").desc_nulls_last(), "value_text")


def dimension(executions: DataFrame, field: str) -> DataFrame:
    """Count and total duration by one of the four dimensions, largest total first."""
    if field not in DIMENSIONS:
        raise ValueError(f"no such dimension: {field}")
    out = executions.groupBy(F.coalesce(field, F.lit("(none)")).alias("value")).agg(F.count("*").alias("cnt"), F.sum("duration_us").alias("total_us"))
    return out.orderBy(F.col("total_us").desc_nulls_last(), "value")


def quality(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.where(F.col("run_id") == run_id).select("events_read", "events_mapped", "events_unmapped", "events_cleaned", "tokenize_failures")


def executions_with_parameters(executions: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each execution with its parameters in order, by one join; no lookups row by row."""
    grouped = parameters.groupBy("execution_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name", "value_text"))), lambda p: F.concat_ws("=", p["name"], p["value_text"])).alias("parameters"))
    return executions.join(grouped, "execution_id", "left").withColumn("parameters", F.coalesce("parameters", F.array().cast("array<string>")))


def signature_times(executions: DataFrame) -> DataFrame:
    """First and last sight of each signature in reading order (not the least and greatest times)."""
    order = F.struct("execution_id")
    return executions.groupBy("normalized_hash").agg(F.min_by("captured_at", order).alias("first_seen_at"), F.max_by("captured_at", order).alias("last_seen_at"), F.min_by("normalized_sql", order).alias("normalized_sql"))


def merged_signatures(known: DataFrame, new: DataFrame) -> DataFrame:
    """The upsert of signatures: what was first stays, the last sight follows the new rows."""
    columns = [c for c in known.columns if c not in ("normalized_hash", "last_seen_at")]
    joined = known.alias("k").join(new.alias("n"), "normalized_hash", "full_outer")
    first = [F.when(F.col("k.first_seen_at").isNotNull(), F.col(f"k.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns]
    return joined.select("normalized_hash", *first, F.coalesce("n.last_seen_at", "k.last_seen_at").alias("last_seen_at")).select(known.columns)
