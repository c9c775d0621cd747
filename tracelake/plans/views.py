"""Tables of a captured workload, projected from the driver's `events`; and the same projections as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAITS = ("Key", "Object", "Page", "Rid", "Other")
LOCKS = ("S", "X", "U")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each captured statement; columns as in the `executions` table, as far as events tell them."""
    u, k = F.col("user_id"), F.get_json_object("props", "$.k")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("execution_id"),
        F.col("ts").alias("captured_at"),
        F.col("event_type").alias("event_name"),
        u.cast("int").alias("session_id"),
        F.concat(F.lit("db"), (u % 5).cast("string")).alias("database_name"),
        F.when(u % 7 != 0, F.concat(F.lit("login"), (u % 7).cast("string"))).alias("login_name"),
        F.when(u % 3 != 0, F.concat(F.lit("host"), (u % 3).cast("string"))).alias("client_hostname"),
        F.concat(F.lit("app"), (u % 2).cast("string")).alias("client_app_name"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("duration_us"),
        F.concat(F.lit("SELECT * FROM dbo."), "event_type", F.lit(" WHERE k = "), k).alias("sql_text_raw"),
        k.alias("k"),
    )


EXECUTIONS_SQL = """executions AS (
  SELECT event_id AS execution_id, ts AS captured_at, event_type AS event_name, CAST(user_id AS INTEGER) AS session_id,
    'db' || CAST(user_id % 5 AS VARCHAR) AS database_name,
    CASE WHEN user_id % 7 <> 0 THEN 'login' || CAST(user_id % 7 AS VARCHAR) END AS login_name,
    CASE WHEN user_id % 3 <> 0 THEN 'host' || CAST(user_id % 3 AS VARCHAR) END AS client_hostname,
    'app' || CAST(user_id % 2 AS VARCHAR) AS client_app_name,
    CAST(floor(value * 1000) AS BIGINT) AS duration_us,
    'SELECT * FROM dbo.' || event_type || ' WHERE k = ' || json_extract_string(props, '$.k') AS sql_text_raw,
    json_extract_string(props, '$.k') AS k,
    'select * from dbo.' || event_type || ' where k = ?' AS normalized_sql,
    sha256('select * from dbo.' || event_type || ' where k = ?') AS normalized_hash,
    'SELECT' AS statement_kind, 'dbo.' || event_type AS primary_table
  FROM events)"""


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions(spark, sf_dir).select("execution_id", F.lit(0).alias("ordinal"), F.lit("@k").alias("name"), F.col("k").alias("value_text"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked-process reports. Spid 0 is never blocked and every other spid of a loop has one blocker, so no walk from a head meets a cycle."""
    e, u = F.col("event_id"), F.col("user_id")
    return events(spark, sf_dir).where(e % 8 != 0).select(e.alias("report_id"), F.col("ts").alias("captured_at"), F.expr("event_id DIV 8").alias("monitor_loop"), (u % 5).cast("int").alias("database_id"), F.when(e % 3 != 0, F.concat(F.lit("<report id='"), e.cast("string"), F.lit("'/>"))).alias("raw_xml"))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each report: who was blocked and by whom."""
    e, u = F.col("event_id"), F.col("user_id")
    text = F.concat(F.lit("select * from dbo."), "event_type", F.lit(" where k = ?"))
    blocked = F.struct(F.lit("blocked").alias("role"), (e % 8).cast("int").alias("spid"), F.floor(F.col("value") * 1000).cast("bigint").alias("wait_time_us"))
    blocking = F.struct(F.lit("blocking").alias("role"), (u % 8).cast("int").alias("spid"), F.lit(0).cast("bigint").alias("wait_time_us"))
    wait = F.element_at(F.array(*map(F.lit, WAITS)), (u % 5 + 1).cast("int"))
    return (
        events(spark, sf_dir)
        .where(e % 8 != 0)
        .select(
            e.alias("report_id"),
            F.explode(F.array(blocked, blocking)).alias("p"),
            wait.alias("wait_resource_type"),
            F.when(u % 5 == 1, u * 10).alias("object_id"),
            F.when(e % 4 != 0, F.element_at(F.array(*map(F.lit, LOCKS)), (e % 4).cast("int"))).alias("lock_mode"),
            F.when(u % 4 != 0, F.concat(F.lit("level "), (u % 4).cast("string"))).alias("isolation_level"),
            F.concat(F.lit("SELECT * FROM dbo."), "event_type").alias("inputbuf"),
            F.when(e % 11 != 0, F.sha2(text, 256)).alias("inputbuf_fingerprint"),
        )
        .select("report_id", "p.*", "wait_resource_type", "object_id", "lock_mode", "isolation_level", "inputbuf", "inputbuf_fingerprint")
    )


BLOCKING_SQL = """reports AS (
  SELECT event_id AS report_id, ts AS captured_at, event_id // 8 AS monitor_loop, CAST(user_id % 5 AS INTEGER) AS database_id,
    CASE WHEN event_id % 3 <> 0 THEN '<report id=''' || CAST(event_id AS VARCHAR) || '''/>' END AS raw_xml
  FROM events WHERE event_id % 8 <> 0),
both_roles AS (
  SELECT *, 'blocked' AS role, CAST(event_id % 8 AS INTEGER) AS spid, CAST(floor(value * 1000) AS BIGINT) AS wait_time_us FROM events WHERE event_id % 8 <> 0
  UNION ALL
  SELECT *, 'blocking' AS role, CAST(user_id % 8 AS INTEGER) AS spid, CAST(0 AS BIGINT) AS wait_time_us FROM events WHERE event_id % 8 <> 0),
processes AS (
  SELECT event_id AS report_id, role, spid, wait_time_us,
    CASE user_id % 5 WHEN 0 THEN 'Key' WHEN 1 THEN 'Object' WHEN 2 THEN 'Page' WHEN 3 THEN 'Rid' ELSE 'Other' END AS wait_resource_type,
    CASE WHEN user_id % 5 = 1 THEN user_id * 10 END AS object_id,
    CASE event_id % 4 WHEN 1 THEN 'S' WHEN 2 THEN 'X' WHEN 3 THEN 'U' END AS lock_mode,
    CASE WHEN user_id % 4 <> 0 THEN 'level ' || CAST(user_id % 4 AS VARCHAR) END AS isolation_level,
    'SELECT * FROM dbo.' || event_type AS inputbuf,
    CASE WHEN event_id % 11 <> 0 THEN sha256('select * from dbo.' || event_type || ' where k = ?') END AS inputbuf_fingerprint
  FROM both_roles),
signatures AS (
  SELECT DISTINCT sha256('select * from dbo.' || event_type || ' where k = ?') AS normalized_hash, 'select * from dbo.' || event_type || ' where k = ?' AS normalized_sql
  FROM events WHERE event_type <> 'click')"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known statement texts; those of clicks were never seen in executions, so that the outer join has rows without a match."""
    text = F.concat(F.lit("select * from dbo."), "event_type", F.lit(" where k = ?"))
    return events(spark, sf_dir).where("event_type <> 'click'").select(F.sha2(text, 256).alias("normalized_hash"), text.alias("normalized_sql")).distinct()
