"""Import of a server's query history into a project: texts, queries, plans, runtime and waits, and a row for the run.

The history's views come from a database over JDBC, or from a folder of Parquet tables of the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import querystore
from .store import Store, written

VERSION = 1
#: The views, by the names under which they are read.
VIEWS = ("query_store_query_text", "query_store_query", "query_store_plan", "query_store_runtime_stats", "query_store_runtime_stats_interval", "query_store_wait_stats", "database_query_store_options")
TABLES = ("qds_query_text", "qds_queries", "qds_plans", "qds_runtime_stats", "qds_wait_stats")

Views = Callable[[str], DataFrame | None]


def from_folder(spark: SparkSession, path: str) -> Views:
    """Views as Parquet tables of a folder; what isn't there is None."""
    store = Store(spark)
    return lambda name: spark.read.parquet(f"{path}/{name}.parquet") if store.exists(f"{path}/{name}.parquet") else None


def from_server(spark: SparkSession, url: str, database: str | None = None, **options: str) -> Views:
    """Views of a server's database. Names and objects of ids are looked up there; all else is left to Spark."""
    where = f"[{database.replace(']', ']]')}]." if database else ""
    columns = {
        "query_store_query": "*, CONVERT(varchar(34), query_hash, 1) AS query_hash_text, QUOTENAME(OBJECT_SCHEMA_NAME(object_id)) + '.' + QUOTENAME(OBJECT_NAME(object_id)) AS object_name",
        "query_store_plan": "*, CONVERT(varchar(34), query_plan_hash, 1) AS query_plan_hash_text",
    }
    read = lambda query: spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    missing = {"query_store_wait_stats"} if not read("SELECT 1 AS one FROM sys.all_objects WHERE name = 'query_store_wait_stats'").count() else set()
    return lambda name: None if name in missing else read(f"SELECT {columns.get(name, '*')} FROM {where}sys.{name}")


def _column(df: DataFrame, kind: str, *names: str):
    """The first of these columns that df has, or null, as this type."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None)).cast(kind)


def extracts(views: Views, window: tuple = (None, None), version: str | None = None) -> dict[str, DataFrame]:
    """The five tables of an import, without the run's number; a plan's XML is its last column."""
    texts, queries, plans, runtime, intervals, waits = (views(n) for n in VIEWS[:6])
    start, end = (None if x is None else F.lit(x).cast("timestamp_ntz") for x in window)
    t = querystore.texts_in_window(texts, queries, plans, runtime, intervals, start, end)
    q = querystore.queries_in_window(queries, plans, runtime, intervals, start, end)
    p = querystore.plans_in_window(plans, runtime, intervals, start, end)
    flag = lambda df, name: F.coalesce(_column(df, "boolean", name), F.lit(False)).alias(name)
    out = {
        "qds_query_text": t.select(F.col("query_text_id").cast("bigint").alias("query_text_id"), "query_sql_text", flag(t, "is_part_of_encrypted_module"), flag(t, "has_restricted_text")),
        "qds_queries": q.select(
            F.col("query_id").cast("bigint").alias("query_id"), F.col("query_text_id").cast("bigint").alias("query_text_id"), _column(q, "bigint", "object_id").alias("object_id"), _column(q, "string", "object_name").alias("object_name"), _column(q, "string", "query_hash_text", "query_hash").alias("query_hash"),
            _column(q, "string", "query_parameterization_type_desc").alias("query_parameterization_type"), flag(q, "is_internal_query"), F.coalesce(_column(q, "bigint", "count_compiles"), F.lit(0)).alias("count_compiles"), _column(q, "timestamp_ntz", "last_execution_time").alias("last_execution_time"),
        ),
        "qds_plans": p.select(
            F.col("plan_id").cast("bigint").alias("plan_id"), F.col("query_id").cast("bigint").alias("query_id"), _column(p, "string", "query_plan_hash_text", "query_plan_hash").alias("query_plan_hash"), _column(p, "string", "engine_version").alias("engine_version"), _column(p, "int", "compatibility_level").alias("compatibility_level"),
            flag(p, "is_forced_plan"), flag(p, "is_trivial_plan"), flag(p, "is_parallel_plan"), F.coalesce(_column(p, "int", "force_failure_count"), F.lit(0)).alias("force_failure_count"), _column(p, "string", "last_force_failure_reason_desc").alias("last_force_failure_reason_desc"),
            F.coalesce(_column(p, "bigint", "count_compiles"), F.lit(0)).alias("count_compiles"), _column(p, "timestamp_ntz", "last_execution_time").alias("last_execution_time"), _column(p, "string", "query_plan").alias("query_plan"),
        ),
    }
    stats = querystore.runtime_stats(runtime, intervals, start, end, version)
    out["qds_runtime_stats"] = stats.withColumnsRenamed({"start_time": "interval_start_time", "end_time": "interval_end_time", "execution_type_desc": "execution_type"})
    if waits is not None:
        out["qds_wait_stats"] = querystore.wait_stats(waits, intervals, start, end)
    return out


def state_of(views: Views) -> tuple[str, str | None]:
    """The history's actual and desired state; raises where it isn't collected."""
    options = views("database_query_store_options")
    row = options.first() if options is not None else None
    actual = row["actual_state_desc"] if row else None
    if actual in (None, "OFF", "ERROR"):
        raise ValueError(f"the database collects no query history (state: {actual or 'absent'})")
    return actual, row["desired_state_desc"] if "desired_state_desc" in options.columns else None


def import_history(project, views: Views, window: tuple = (None, None), database: str | None = None, server: str | None = None, version: str | None = None, write_plans: bool = True) -> dict:
    """Imports the history as one run. Its row is written last, so a broken import has none; returns that row."""
    actual, desired = state_of(views)
    spark, store = project.spark, Store(project.spark)
    run, began = project.next_id("qds_runs", "run_id"), datetime.now(timezone.utc).replace(tzinfo=None)
    tables = extracts(views, window, version)
    plans = written(tables["qds_plans"], "plans")
    files, failures = [], 0
    if write_plans:
        store.make_folder(f"{project.path}/plans/qds")
        # One file for each plan with XML; rows come to the driver one partition at a time.
        for r in plans.where(F.col("query_plan").isNotNull()).select("plan_id", "query_plan").toLocalIterator():
            try:
                store.write(f"{project.path}/plans/qds/{r.plan_id}.sqlplan", r.query_plan)
                files.append((r.plan_id, f"qds/{r.plan_id}.sqlplan"))
            except Exception:  # what the file system raises comes through the gateway
                failures += 1
    paths = spark.createDataFrame(files, "plan_id bigint, sqlplan_path string")
    tables["qds_plans"] = plans.drop("query_plan").join(paths, "plan_id", "left").withColumn("plan_written", F.col("sqlplan_path").isNotNull())
    counts = {}
    for name, rows in tables.items():
        project.append(name, rows.select(F.lit(run).cast("bigint").alias("run_id"), "*"))
        counts[name] = project.table(name).where(F.col("run_id") == run).count()
    row = {
        "run_id": run, "server_name": server, "database_name": database, "captured_at": began, "window_from": window[0], "window_to": window[1], "sql_server_version": version, "query_store_actual_state": actual, "query_store_desired_state": desired,
        "wait_stats_available": "qds_wait_stats" in tables, "plans_requested": write_plans, "queries_count": counts["qds_queries"], "query_text_count": counts["qds_query_text"], "plans_count": counts["qds_plans"], "runtime_stat_rows": counts["qds_runtime_stats"],
        "wait_stat_rows": counts.get("qds_wait_stats", 0), "plan_files_written": len(files), "plan_write_failures": failures, "extractor_version": VERSION,
    }
    kinds = "run_id bigint, server_name string, database_name string, captured_at timestamp_ntz, window_from timestamp_ntz, window_to timestamp_ntz, sql_server_version string, query_store_actual_state string, query_store_desired_state string, wait_stats_available boolean, plans_requested boolean, queries_count bigint, query_text_count bigint, plans_count bigint, runtime_stat_rows bigint, wait_stat_rows bigint, plan_files_written bigint, plan_write_failures bigint, extractor_version int"
    project.append("qds_runs", spark.createDataFrame([tuple(row.values())], kinds))
    return row
