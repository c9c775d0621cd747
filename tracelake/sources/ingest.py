"""From landed events to typed tables.

A landed event is (name, ts, fields map, actions map, file_name, file_offset). All of mapping, routing, normalizing and
redacting is one narrow stage but for two shuffles: distinct statement texts, and signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fields
from ..functions.sqltext import with_signatures
from ..operators.filters import Rule, ingest
from ..operators.xmlreports import parse_blocking, parse_deadlock
from .store import Store, written

RAW = "name string, ts timestamp_ntz, fields map<string,string>, actions map<string,string>, file_name string, file_offset bigint"
NORMALIZER_VERSION = 1


def resolve(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """The capture files of a folder by name (not of folders below it), or the one file; their order decides ids."""
    store = Store(spark)
    if not store.exists(path):
        raise FileNotFoundError(path)
    if store.is_file(path):
        return [path]
    return [at for at, name, is_file, _ in store.children(path) if is_file and name.lower().endswith(suffix)]


def captures(spark: SparkSession, path: str) -> list[str]:
    """The files of the landing format under a path: Parquet, or JSON lines where there is none."""
    return resolve(spark, path, ".parquet") or resolve(spark, path, ".jsonl")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Events of the landing format under a path: Parquet, or JSON lines."""
    files = captures(spark, path)
    if not files:
        return spark.createDataFrame([], RAW)
    return (spark.read.schema(RAW).parquet(*files)) if files[0].lower().endswith(".parquet") else spark.read.schema(RAW).json(files)


def mapped(raw: DataFrame) -> DataFrame:
    """The typed columns of each event; a value that can't be converted fails the job."""
    f, a = F.col("fields"), F.col("actions")
    kind = fields.event_class(F.col("name"))
    text = fields.statement_text(kind, f)
    number = lambda name, to="bigint": f[name].cast(to)
    return raw.select(
        F.col("ts").alias("captured_at"),
        F.col("name").alias("event_name"),
        F.when(text.isNull(), "Unknown").otherwise(kind).alias("event_class"),
        fields.blocking_class(F.col("name")).alias("blocking_class"),
        f["object_name"].alias("object_name"),
        F.coalesce(a["is_system"].cast("boolean"), F.lit(False)).alias("is_system"),
        a["database_name"].alias("database_name"),
        F.coalesce(a["server_principal_name"], a["username"]).alias("login_name"),
        a["client_hostname"].alias("client_hostname"),
        a["client_app_name"].alias("client_app_name"),
        a["session_id"].cast("int").alias("session_id"),
        number("duration").alias("duration_us"),
        number("cpu_time").alias("cpu_time_us"),
        number("logical_reads").alias("logical_reads"),
        number("physical_reads").alias("physical_reads"),
        number("writes").alias("writes"),
        number("row_count").alias("row_count"),
        a["query_hash"].alias("query_hash"),
        a["query_plan_hash"].alias("query_plan_hash"),
        F.coalesce(text, F.lit("")).alias("sql_text_raw"),
        f["blocked_process"].alias("blocked_process"),
        f["xml_report"].alias("xml_report"),
        F.col("file_name").alias("xe_file_name"),
        "file_offset",
    )


def outcomes(raw: DataFrame, rules: list[Rule] = ()) -> DataFrame:
    """Mapped events with `outcome`: blocking, deadlock, unmapped, cleaned or mapped; each event has one."""
    outcome = (
        F.when(F.col("blocking_class") == "BlockedProcess", "blocking")
        .when(F.col("blocking_class") == "Deadlock", "deadlock")
        .when((F.col("event_class") == "Unknown") | (F.trim("sql_text_raw") == ""), "unmapped")
        .when(~ingest(list(rules)), "cleaned")
        .otherwise("mapped")
    )
    return mapped(raw).withColumn("outcome", outcome)


def numbered(df: DataFrame, name: str, first: int, order: list[Column]) -> DataFrame:
    """df with dense ids from `first` in the given order, without bringing all rows to one task.

    Range partitions are counted (a row each comes to the driver) and number their own rows from where they begin. They are
    written first: a lost executor then can't deal rows of equal order anew between the count and the numbers."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    starts, at = [], first
    for part, n in sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()):
        starts.append((part, at))
        at += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _first bigint"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(offsets, "_part").withColumn(name, F.col("_first") + place - 1).drop("_part", "_first")


def tables(raw: DataFrame, run_id: int = 1, redaction: str = "masked", rules: list[Rule] = (), next_ids: tuple[int, int, int] = (1, 1, 1)) -> dict[str, DataFrame]:
    """executions, normalized_queries, execution_parameters, blocking_reports, blocking_processes, deadlock_reports and run_counters of one import."""
    order = [F.col("xe_file_name"), F.col("file_offset")]
    events = written(outcomes(raw, rules), "events")
    own = with_signatures(numbered(events.where("outcome = 'mapped'"), "execution_id", next_ids[0], order)).withColumn("run_id", F.lit(run_id).cast("bigint"))
    executions = written(own.drop("blocking_class", "blocked_process", "xml_report", "outcome"), "executions")
    seen = lambda c: F.struct("execution_id", c)[c]
    signatures = executions.groupBy("normalized_hash").agg(
        *(F.min_by(c, "execution_id").alias(c) for c in ("normalized_sql", "statement_kind", "primary_table")), F.min_by(seen("captured_at"), "execution_id").alias("first_seen_at"), F.max_by(seen("captured_at"), "execution_id").alias("last_seen_at")
    ).withColumn("normalizer_version", F.lit(NORMALIZER_VERSION))
    parameters = executions.select("execution_id", F.explode(fields.parameters(F.col("sql_text_raw"), F.col("event_class"))).alias("p")).select("execution_id", "p.*", fields.redacted(redaction, F.col("p.name"), F.col("p.value")).alias("r"))
    parameters = parameters.select("execution_id", "ordinal", "name", "source_kind", "sql_type_guess", "r.value_text", "r.value_redacted", F.lit(False).alias("is_truncated"), "parse_confidence")
    if redaction == "off":
        parameters = parameters.limit(0)

    found = parse_blocking(events.where("outcome = 'blocking'"), "blocked_process")
    whole = numbered(found.where("report IS NOT NULL"), "report_id", next_ids[1], order)
    reports = whole.select("report_id", F.lit(run_id).cast("bigint").alias("run_id"), "captured_at", "report.monitor_loop", "report.database_id", fields.stored_xml(redaction, F.col("blocked_process"), None).alias("raw_xml"))
    both = whole.select("report_id", F.explode(F.array(*(F.struct(F.lit(s).alias("role"), F.col(f"report.{s}").alias("p")) for s in ("blocked", "blocking")))).alias("x")).select("report_id", "x.role", "x.p.*")
    described = with_signatures(both, "inputbuf")
    stored = F.when(F.col("inputbuf").isNotNull(), fields.inputbuf(redaction, F.col("inputbuf"), F.col("normalized_sql"), F.col("tokenize_failed")))
    processes = described.withColumn("inputbuf_fingerprint", F.when(F.trim(F.coalesce("inputbuf", F.lit(""))) != "", F.col("normalized_hash"))).withColumn("inputbuf", stored).drop("normalized_sql", "tokenize_failed", "statement_kind", "primary_table", "normalized_hash")
    dead = parse_deadlock(events.where("outcome = 'deadlock'"), "xml_report")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    deadlocks = numbered(dead.where("participant_spids IS NOT NULL"), "report_id", next_ids[2], order).select("report_id", F.lit(run_id).cast("bigint").alias("run_id"), "captured_at", joined("victim_spids"), joined("participant_spids"), fields.stored_xml(redaction, F.col("xml_report"), "<redacted/>").alias("graph_xml"))

    counted = lambda o: F.count_if(F.col("outcome") == o)
    counters = events.agg(F.count("*").alias("events_read"), *(counted(o).alias(f"events_{o}") for o in ("mapped", "unmapped", "cleaned")), counted("blocking").alias("blocking_seen"), counted("deadlock").alias("deadlocks_seen"))
    parsed = reports.agg(F.count("*").alias("events_blocking")).crossJoin(deadlocks.agg(F.count("*").alias("events_deadlocks")))  # one row each
    failed = executions.agg(F.count_if("tokenize_failed").alias("tokenize_failures"))
    run = counters.crossJoin(parsed).crossJoin(failed).withColumn("blocking_parse_failures", F.col("blocking_seen") + F.col("deadlocks_seen") - F.col("events_blocking") - F.col("events_deadlocks")).drop("blocking_seen", "deadlocks_seen")
    run = run.select(F.lit(run_id).cast("bigint").alias("run_id"), "*", F.lit(NORMALIZER_VERSION).alias("normalizer_version"), F.lit(redaction).alias("redaction_policy"))
    return {"executions": executions.drop("tokenize_failed", "normalized_sql", "statement_kind", "primary_table"), "normalized_queries": signatures, "execution_parameters": parameters, "blocking_reports": reports, "blocking_processes": processes, "deadlock_reports": deadlocks, "ingestion_runs": run}
