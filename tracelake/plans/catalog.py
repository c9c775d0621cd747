"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.sqltext import with_signatures
from ..operators import blocking, export, filters, querystore, workload
from ..operators.filters import Rule
from . import views
from .views import BLOCKING_SQL, EXECUTIONS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_signatures(views.executions(spark, sf_dir))


# Statements.
_STATS = """SELECT normalized_hash, statement_kind, primary_table, normalized_sql, count(*) AS cnt, round(sum(duration_us) / count(duration_us), 4) AS avg_us,
  round(quantile_cont(duration_us, 0.95), 2) AS p95_us, max(duration_us) AS max_us, CAST(sum(duration_us) AS BIGINT) AS total_us
FROM executions {where} GROUP BY ALL"""


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """df with some columns rounded, so that both engines print the same."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _top(sort: str, rules: tuple = (), text: str | None = None, limit: int = 20):
    return lambda spark, sf_dir: rounded(workload.top_statements(signed(spark, sf_dir), limit, sort, list(rules), text), avg_us=4, p95_us=2)


for _sort, _column in workload.SORTS.items():
    _query("top_frequent" if _sort == "count" else f"top_slow_{_sort}", f"WITH {EXECUTIONS_SQL} {_STATS.format(where='')} ORDER BY {_column} DESC, normalized_hash LIMIT 20")(_top(_sort))

FILTERED = {
    "in_keep": (Rule("database_name", "in", values=("db1", "db3")), "database_name IN ('db1', 'db3')"),
    "in_exclude": (Rule("login_name", "in", values=("login1", "login2"), action="exclude"), "login_name NOT IN ('login1', 'login2')"),
    "eq_keep": (Rule("client_hostname", "eq", "host1"), "client_hostname = 'host1'"),
    "eq_exclude": (Rule("login_name", "eq", "login3", action="exclude"), "login_name <> 'login3'"),
    "neq_keep": (Rule("login_name", "neq", "login3"), "login_name <> 'login3'"),
    "gt_keep": (Rule("duration_us", "gt", "50000"), "duration_us > 50000"),
    "lt_keep": (Rule("duration_us", "lt", "50000"), "duration_us < 50000"),
    "gte_exclude": (Rule("session_id", "gte", "40", action="exclude"), "NOT (session_id >= 40)"),
    "lte_keep": (Rule("session_id", "lte", "40"), "session_id <= 40"),
    "like_keep": (Rule("login_name", "like", "login%"), "login_name LIKE 'login%'"),
    "like_exclude": (Rule("login_name", "like", "%1", action="exclude"), "login_name NOT LIKE '%1'"),
}
for _name, (_rule, _sql) in FILTERED.items():
    _query(f"filter_{_name}", f"WITH {EXECUTIONS_SQL} {_STATS.format(where=f'WHERE {_sql}')} ORDER BY total_us DESC, normalized_hash LIMIT 20")(_top("total", (_rule,)))
_query("filter_combined_text", f"WITH {EXECUTIONS_SQL} {_STATS.format(where=chr(32).join(('WHERE', FILTERED['in_exclude'][1], 'AND', FILTERED['gt_keep'][1], 'AND', 'normalized_sql ILIKE', chr(39) + '%DBO.%' + chr(39))))} ORDER BY total_us DESC, normalized_hash LIMIT 2")(_top("total", (FILTERED["in_exclude"][0], FILTERED["gt_keep"][0]), "DBO.", 2))


@_query("fingerprints", f"WITH {EXECUTIONS_SQL} SELECT DISTINCT sql_text_raw, normalized_sql, normalized_hash, statement_kind, primary_table, false AS tokenize_failed FROM executions")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(spark, sf_dir).select("sql_text_raw", "normalized_sql", "normalized_hash", "statement_kind", "primary_table", "tokenize_failed").distinct()


#: Statements of many shapes (%s stands for a number): normal form, kind and table. A form of None falls back to the text in lower case.
SHAPES = (
    ("SELECT o.Id, c.Name FROM dbo.Orders o INNER JOIN [Cust omers] c ON o.Cid = c.Id WHERE o.N > %s", "select o.Id, c.Name from dbo.Orders o inner join [Cust omers] c on o.Cid = c.Id where o.N > ?", "SELECT", None),
    ("MERGE t USING s ON t.Id = s.Id AND t.N = %s WHEN MATCHED THEN DELETE;", "MERGE t USING s on t.Id = s.Id and t.N = ? when MATCHED then delete;", "OTHER", None),
    ("SELECT a FROM dbo.T WHERE k = %s UNION ALL SELECT b FROM dbo.U", "select a from dbo.T where k = ? union all select b from dbo.U", "SELECT", None),
    ("INSERT INTO dbo.Log (A, B) VALUES (%s, N'it''s')", "insert into dbo.Log (A, B) values (?, ?)", "INSERT", "dbo.Log"),
    ("UPDATE  [my db].dbo.T /* why */ SET a = %s -- end", "update [my db].dbo.T set a = ?", "UPDATE", "my db.dbo.T"),
    ("DELETE FROM Logs WHERE Id IN ( %s , 2,3 ) AND x IN (4)", "delete from Logs where Id in (?) and x in (?)", "DELETE", "Logs"),
    ("EXEC @r = dbo.GetOrder @Id = %s, @s = 0x1F", "exec @r = dbo.GetOrder @Id = ?, @s = ?", "EXEC", "dbo.GetOrder"),
    ("SELECT * FROM (SELECT TOP 5 x FROM dbo.V WHERE y = %s) d", "select * from (select top ? x from dbo.V where y = ?) d", "SELECT", None),
    ("SELECT  'open %s FROM T", None, "OTHER", None),
    ("@@@  not SQL (( %s", None, "OTHER", None),
)


def _quoted_sql(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _shapes_sql() -> str:
    number = "CAST(event_id % 7 + 10 AS VARCHAR)"
    raw = lambda t: f"replace({_quoted_sql(t)}, '%s', {number})"
    case = lambda part: "CASE event_id % " + str(len(SHAPES)) + " " + " ".join(f"WHEN {i} THEN {part(shape)}" for i, shape in enumerate(SHAPES)) + " END"
    form = lambda x: _quoted_sql(x[1]) if x[1] else f"regexp_replace(trim(lower({raw(x[0])})), '\\s+', ' ', 'g')"
    return f"SELECT event_id, {case(lambda x: raw(x[0]))} AS sql_text_raw, {case(form)} AS normalized_sql, {case(lambda x: str(x[1] is None).lower())} AS tokenize_failed, {case(lambda x: _quoted_sql(x[2]))} AS statement_kind, CAST({case(lambda x: _quoted_sql(x[3]))} AS VARCHAR) AS primary_table FROM events"


@_query("statement_shapes", _shapes_sql())
def statement_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements beyond plain queries, one shape after another."""
    e = F.col("event_id")
    text = F.replace(F.element_at(F.array(*(F.lit(x[0]) for x in SHAPES)), (e % len(SHAPES) + 1).cast("int")), F.lit("%s"), (e % 7 + 10).cast("string"))
    return with_signatures(views.events(spark, sf_dir).select("event_id", text.alias("sql_text_raw"))).select("event_id", "sql_text_raw", "normalized_sql", "tokenize_failed", "statement_kind", "primary_table")


@_query("signature_first_last", f"WITH {EXECUTIONS_SQL} SELECT normalized_hash, min_by(captured_at, execution_id) AS first_seen_at, max_by(captured_at, execution_id) AS last_seen_at, min_by(normalized_sql, execution_id) AS normalized_sql FROM executions GROUP BY normalized_hash")
def signature_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.signature_times(signed(spark, sf_dir))


@_query(
    "signature_upsert",
    f"""WITH {EXECUTIONS_SQL}, k AS (SELECT normalized_hash, min_by(normalized_sql, execution_id) AS normalized_sql, min_by(captured_at, execution_id) AS first_seen_at, max_by(captured_at, execution_id) AS last_seen_at FROM executions WHERE execution_id % 2 = 0 AND event_name <> 'click' GROUP BY 1),
    n AS (SELECT normalized_hash, min_by(normalized_sql, execution_id) AS normalized_sql, min_by(captured_at, execution_id) AS first_seen_at, max_by(captured_at, execution_id) AS last_seen_at FROM executions WHERE execution_id % 2 = 1 GROUP BY 1)
    SELECT coalesce(k.normalized_hash, n.normalized_hash) AS normalized_hash, coalesce(k.normalized_sql, n.normalized_sql) AS normalized_sql, coalesce(k.first_seen_at, n.first_seen_at) AS first_seen_at, coalesce(n.last_seen_at, k.last_seen_at) AS last_seen_at FROM k FULL JOIN n ON k.normalized_hash = n.normalized_hash""",
)
def signature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed(spark, sf_dir)
    known = workload.signature_times(rows.where("execution_id % 2 = 0 AND event_name <> 'click'"))
    return workload.merged_signatures(known, workload.signature_times(rows.where("execution_id % 2 = 1"))).select("normalized_hash", "normalized_sql", "first_seen_at", "last_seen_at")


@_query("occurrences", f"WITH {EXECUTIONS_SQL} SELECT execution_id, captured_at, database_name, login_name, session_id, duration_us FROM executions WHERE normalized_hash = sha256('select * from dbo.click where k = ?') ORDER BY captured_at, execution_id LIMIT 100")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.sha2(F.lit("select * from dbo.click where k = ?"), 256)).first()[0]
    return workload.occurrences(signed(spark, sf_dir), wanted).select("execution_id", "captured_at", "database_name", "login_name", "session_id", "duration_us")


@_query("session_flow", f"WITH {EXECUTIONS_SQL} SELECT execution_id, captured_at, sql_text_raw, duration_us FROM executions WHERE session_id = 7 AND captured_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def session_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return workload.session_flow(views.executions(spark, sf_dir), 7, at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00")).select("execution_id", "captured_at", "sql_text_raw", "duration_us")


@_query("parameter_impact", f"WITH {EXECUTIONS_SQL} SELECT k AS value_text, count(*) AS cnt, round(sum(duration_us) / count(duration_us), 4) AS avg_us, round(quantile_cont(duration_us, 0.95), 2) AS p95_us, max(duration_us) AS max_us FROM executions WHERE event_name = 'click' GROUP BY k")
def parameter_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = views.executions(spark, sf_dir).where("event_name = 'click'")
    return rounded(workload.parameter_impact(clicks, views.parameters(spark, sf_dir), "@k"), avg_us=4, p95_us=2)


for _field in workload.DIMENSIONS:
    _query(f"dimension_{_field}", f"WITH {EXECUTIONS_SQL} SELECT coalesce({_field}, '(none)') AS value, count(*) AS cnt, CAST(sum(duration_us) AS BIGINT) AS total_us FROM executions GROUP BY 1")(lambda spark, sf_dir, field=_field: workload.dimension(views.executions(spark, sf_dir), field))


@_query("load_execution", f"WITH {EXECUTIONS_SQL} SELECT execution_id, captured_at, sql_text_raw, '@k=' || k AS parameters FROM executions")
def load_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.executions_with_parameters(views.executions(spark, sf_dir), views.parameters(spark, sf_dir)).select("execution_id", "captured_at", "sql_text_raw", F.array_join("parameters", ",").alias("parameters"))


@_query("next_execution_id", f"WITH {EXECUTIONS_SQL} SELECT coalesce(max(execution_id), 0) + 1 AS next_id FROM executions")
def next_execution_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.executions(spark, sf_dir).agg((F.coalesce(F.max("execution_id"), F.lit(0)) + 1).alias("next_id"))


# Events on their way in.
_OUTCOME = """CASE WHEN event_id % 13 = 0 THEN 'blocking' WHEN event_id % 17 = 0 THEN 'deadlock' WHEN user_id % 6 = 0 THEN 'unmapped' WHEN lower(login) = 'login1' THEN 'cleaned' ELSE 'mapped' END"""


@_query(
    "ingest_outcomes",
    f"""WITH e AS (SELECT *, CASE WHEN user_id % 7 <> 0 THEN 'login' || CAST(user_id % 7 AS VARCHAR) END AS login FROM events)
    SELECT {_OUTCOME} AS outcome, count(*) AS cnt FROM e GROUP BY 1""",
)
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.ingest import outcomes

    return outcomes(raw_events(spark, sf_dir), [Rule("login_name", "eq", "LOGIN1", stage="ingest", action="exclude")]).groupBy("outcome").agg(F.count("*").alias("cnt"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the landing format: some blocked-process and deadlock reports, some events that nothing maps."""
    e, u = F.col("event_id"), F.col("user_id")
    name = F.when(e % 13 == 0, "blocked_process_report").when(e % 17 == 0, "xml_deadlock_report").when(u % 6 == 0, "login").when(u % 2 == 0, "rpc_completed").otherwise("sql_batch_completed")
    text = F.concat(F.lit("exec dbo."), "event_type", F.lit(" @k = "), F.get_json_object("props", "$.k"), F.lit(", @s = N'it''s'"))
    xml = F.concat(F.lit("<blocked-process-report monitorLoop='"), (e % 9).cast("string"), F.lit("'><blocked-process><process spid='"), (e % 50).cast("string"), F.lit("' waitresource='OBJECT: 5:1977058079:0' waittime='"), (e % 100).cast("string"), F.lit("'><inputbuf> "), text, F.lit(" </inputbuf></process></blocked-process><blocking-process><process spid='7'/></blocking-process></blocked-process-report>"))
    fields_map = F.create_map(F.lit("batch_text"), text, F.lit("statement"), text, F.lit("duration"), F.floor(F.col("value") * 1000).cast("string"), F.lit("object_name"), F.concat(F.lit("dbo."), "event_type"), F.lit("blocked_process"), xml, F.lit("xml_report"), F.concat(F.lit("<deadlock><process-list><process spid='"), (e % 50).cast("string"), F.lit("'/></process-list></deadlock>")))
    actions = F.create_map(F.lit("database_name"), F.concat(F.lit("db"), (u % 5).cast("string")), F.lit("session_id"), u.cast("string"), F.lit("username"), F.when(u % 7 != 0, F.concat(F.lit("login"), (u % 7).cast("string"))))
    return views.events(spark, sf_dir).select(name.alias("name"), F.col("ts").alias("ts"), fields_map.alias("fields"), actions.alias("actions"), F.lit("a.capture").alias("file_name"), e.alias("file_offset"))


@_query(
    "event_classes",
    """SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 OR user_id % 6 = 0 THEN 'Unknown' WHEN user_id % 2 = 0 THEN 'RpcCall' ELSE 'SqlBatch' END AS event_class,
    CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 OR user_id % 6 = 0 THEN NULL ELSE 'exec dbo.' || event_type || ' @k = ' || json_extract_string(props, '$.k') || ', @s = N''it''''s''' END AS sql_text,
    CASE WHEN event_id % 13 = 0 THEN 'BlockedProcess' WHEN event_id % 17 = 0 THEN 'Deadlock' ELSE 'None' END AS blocking_class FROM events""",
)
def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = fields.event_class(F.col("name"))
    return raw_events(spark, sf_dir).select(F.col("file_offset").alias("event_id"), kind.alias("event_class"), fields.statement_text(kind, F.col("fields")).alias("sql_text"), fields.blocking_class(F.col("name")).alias("blocking_class"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("exec p @k = "), F.get_json_object("props", "$.k"), F.lit(", @s = N'it''s', @v='x', @d = 1.5, @password = abc"))
    return views.events(spark, sf_dir).select("event_id", F.explode(fields.parameters(text, F.lit("RpcCall"))).alias("p")).select("event_id", "p.*")


_EXTRACTED_SQL = """parts AS (SELECT event_id, 0 AS ordinal, '@k' AS name, json_extract_string(props, '$.k') AS value, 'int' AS sql_type_guess FROM events
  UNION ALL SELECT event_id, 1, '@s', 'N''it''''s''', 'nvarchar' FROM events UNION ALL SELECT event_id, 2, '@v', '''x''', 'varchar' FROM events
  UNION ALL SELECT event_id, 3, '@d', '1.5', 'decimal' FROM events UNION ALL SELECT event_id, 4, '@password', 'abc', 'unknown' FROM events)"""


@_query("parameter_extract", f"WITH {_EXTRACTED_SQL} SELECT event_id, CAST(ordinal AS INTEGER) AS ordinal, name, value, 'RpcParameter' AS source_kind, sql_type_guess, CAST(0.9 AS DOUBLE) AS parse_confidence FROM parts")
def parameter_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("event_id", "ordinal", "name", "value", "source_kind", "sql_type_guess", F.col("parse_confidence").cast("double").alias("parse_confidence"))


_MODES = {"off": "''", "masked": "repeat('*', greatest(1, least(length(value), 8)))", "hash": "sha256(value)", "full": "value"}
for _mode, _sql in _MODES.items():

    @_query(f"redact_{_mode}", f"WITH {_EXTRACTED_SQL} SELECT event_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN name = '@password' THEN sha256(value) ELSE {_sql} END AS value_text, (name = '@password' OR {str(_mode != 'full').lower()}) AS value_redacted FROM parts")
    def _redact(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        return _extracted(spark, sf_dir).select("event_id", "ordinal", fields.redacted(mode, F.col("name"), F.col("value")).alias("r")).select("event_id", "ordinal", "r.*")


@_query(
    "wait_resource_parse",
    """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OBJECT: 5:' || CAST(user_id AS VARCHAR) || ':0' WHEN 1 THEN 'KEY: 6:' || CAST(user_id AS VARCHAR) || ' (81a0)' WHEN 2 THEN 'PAGELATCH_EX: 2:1:128' WHEN 3 THEN 'APPLICATION: 5:0:[Form]' ELSE 'METADATA: ' || event_type END AS raw, user_id FROM events)
    SELECT event_id, raw, CASE event_id % 5 WHEN 0 THEN 'Object' WHEN 1 THEN 'Key' WHEN 2 THEN 'PageLatch' WHEN 3 THEN 'AppLock' ELSE 'Other' END AS type, CASE event_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 2 WHEN 3 THEN 5 END AS database_id,
    CASE WHEN event_id % 5 = 0 THEN user_id END AS object_id, CASE WHEN event_id % 5 = 1 THEN user_id END AS hobt_id FROM r""",
)
def wait_resource_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    raw = F.when(e == 0, F.concat(F.lit("OBJECT: 5:"), u, F.lit(":0"))).when(e == 1, F.concat(F.lit("KEY: 6:"), u, F.lit(" (81a0)"))).when(e == 2, "PAGELATCH_EX: 2:1:128").when(e == 3, "APPLICATION: 5:0:[Form]").otherwise(F.concat(F.lit("METADATA: "), "event_type"))
    return views.events(spark, sf_dir).select("event_id", raw.alias("raw")).select("event_id", "raw", fields.wait_resource(F.col("raw")).alias("w")).select("event_id", "raw", "w.*")


@_query(
    "replay_scripts",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'RawBatch' WHEN 1 THEN 'ExecProc' ELSE 'SpExecuteSql' END AS kind,
    CASE event_id % 3 WHEN 0 THEN 'select 1' WHEN 1 THEN 'EXEC dbo.' || event_type || ' @k = ' || json_extract_string(props, '$.k') || ', @b = 2;' ELSE 'exec SP_ExecuteSql N''select @k''' END AS script,
    CAST(CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.7 END AS DOUBLE) AS confidence FROM events""",
)
def replay_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 3
    pair = lambda n, v, c: F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(c).cast("double").alias("parse_confidence"))
    params = F.array(pair("@k", F.get_json_object("props", "$.k"), 0.9), pair("@b", F.lit("2"), 0.6))
    text = F.when(e == 0, "select 1").when(e == 1, "anything").otherwise("exec SP_ExecuteSql N'select @k'")
    built = fields.replay(F.when(e == 0, "SqlBatch").otherwise("RpcCall"), text, F.concat(F.lit("dbo."), "event_type"), params)
    return views.events(spark, sf_dir).select("event_id", built.alias("r")).select("event_id", "r.kind", "r.script", F.col("r.confidence").cast("double").alias("confidence"))


@_query(
    "inputbuf_redaction",
    f"""WITH {EXECUTIONS_SQL} SELECT execution_id, sql_text_raw AS off_text, CASE WHEN execution_id % 4 = 0 THEN '{fields.PLACEHOLDER}' ELSE normalized_sql END AS masked_text, CASE WHEN length(sql_text_raw) > 20 THEN substr(sql_text_raw, 1, 20) || '...' ELSE sql_text_raw END AS shown FROM executions""",
)
def inputbuf_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, failed = F.col("sql_text_raw"), F.col("execution_id") % 4 == 0
    return signed(spark, sf_dir).select("execution_id", fields.inputbuf("off", raw, F.col("normalized_sql"), failed).alias("off_text"), fields.inputbuf("masked", raw, F.col("normalized_sql"), failed).alias("masked_text"), fields.shortened(raw, 20).alias("shown"))


# Blocking.
def _blocked(sql: str) -> str:
    return f"WITH {BLOCKING_SQL} {sql}"


def _counts_sql(column: str, where: str = "", limit: str = "") -> str:
    return _blocked(f"SELECT coalesce(CAST({column} AS VARCHAR), '(none)') AS key, count(*) AS cnt FROM processes WHERE role = 'blocked' {where} GROUP BY 1 ORDER BY cnt DESC, key {limit}")


def _deadlocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return views.events(spark, sf_dir).where(e % 17 == 0).select(e.alias("report_id"), F.col("ts").alias("captured_at"), F.when(e % 2 == 0, export.REDACTED).otherwise(F.concat(F.lit("<deadlock id='"), e.cast("string"), F.lit("'/>"))).alias("graph_xml"))


@_query("blocking_overview", _blocked("SELECT (SELECT count(*) FROM reports) AS blocking_reports, (SELECT min(captured_at) FROM reports) AS first_at, (SELECT max(captured_at) FROM reports) AS last_at, (SELECT count(*) FROM events WHERE event_id % 17 = 0) AS deadlock_reports"))
def blocking_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.overview(views.reports(spark, sf_dir), _deadlocks(spark, sf_dir))


@_query("locality", _blocked("SELECT wait_resource_type, count(*) AS cnt, round(100.0 * count(*) / nullif(sum(count(*)) OVER (), 0), 6) AS pct FROM processes WHERE role = 'blocked' GROUP BY 1"))
def locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocking.locality(views.processes(spark, sf_dir)), pct=6)


@_query("top_objects", _counts_sql("object_id", "AND object_id IS NOT NULL", "LIMIT 10"))
def top_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.counts_by(views.processes(spark, sf_dir), "object_id", True, 10)


for _name, _column in (("lock_modes", "lock_mode"), ("isolation_levels", "isolation_level")):
    _query(_name, _counts_sql(_column))(lambda spark, sf_dir, column=_column: blocking.counts_by(views.processes(spark, sf_dir), column))

for _name, _role in (("top_blockers", "blocking"), ("top_blocked", "blocked")):
    _query(_name, _blocked(f"SELECT inputbuf_fingerprint, coalesce(s.normalized_sql, inputbuf, '(none)') AS display_sql, count(*) AS cnt FROM processes p LEFT JOIN signatures s ON p.inputbuf_fingerprint = s.normalized_hash WHERE role = '{_role}' AND inputbuf_fingerprint IS NOT NULL GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 10"))(
        lambda spark, sf_dir, role=_role: blocking.top_statements(views.processes(spark, sf_dir), views.signatures(spark, sf_dir), role)
    )


@_query("wait_times", _blocked("SELECT round(coalesce(quantile_cont(wait_time_us, 0.5), 0), 2) AS p50_us, round(coalesce(quantile_cont(wait_time_us, 0.95), 0), 2) AS p95_us, coalesce(max(wait_time_us), 0) AS max_us FROM processes WHERE role = 'blocked'"))
def wait_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocking.wait_times(views.processes(spark, sf_dir)), p50_us=2, p95_us=2)


@_query("blocking_edges", "SELECT event_id // 8 AS loop, CAST(user_id % 8 AS INTEGER) AS blocking, CAST(event_id % 8 AS INTEGER) AS blocked FROM events WHERE event_id % 8 <> 0")
def blocking_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.edges(views.reports(spark, sf_dir), views.processes(spark, sf_dir))


@_query(
    "blocking_chains",
    """WITH RECURSIVE links AS (SELECT event_id // 8 AS loop, CAST(event_id % 8 AS INTEGER) AS blocked, CAST(user_id % 8 AS INTEGER) AS blocking FROM events WHERE event_id % 8 <> 0),
    heads AS (SELECT a.loop, a.blocking AS head FROM (SELECT DISTINCT loop, blocking FROM links) a LEFT JOIN (SELECT DISTINCT loop, blocked FROM links) b ON a.loop = b.loop AND a.blocking = b.blocked WHERE b.loop IS NULL),
    steps AS (SELECT DISTINCT loop, blocking, blocked FROM links),
    levels AS (SELECT loop, head, head AS place, 1 AS level FROM heads UNION SELECT u.loop, u.head, s.blocked, u.level + 1 FROM levels u, steps s WHERE s.loop = u.loop AND s.blocking = u.place AND u.level <= 63),
    sizes AS (SELECT loop, count(*) AS edges FROM links GROUP BY loop)
    SELECT u.loop AS loop, u.head AS head, max(u.level) AS depth, min(z.edges) AS edges FROM levels u JOIN sizes z ON z.loop = u.loop GROUP BY u.loop, u.head""",
)
def blocking_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.chains(views.reports(spark, sf_dir), views.processes(spark, sf_dir))


@_query("blocking_heads", "WITH links AS (SELECT event_id // 8 AS loop, CAST(event_id % 8 AS INTEGER) AS blocked, CAST(user_id % 8 AS INTEGER) AS blocking FROM events WHERE event_id % 8 <> 0) SELECT DISTINCT loop, blocking AS head FROM links e WHERE NOT EXISTS (SELECT 1 FROM links x WHERE x.loop = e.loop AND x.blocked = e.blocking)")
def blocking_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = blocking.edges(views.reports(spark, sf_dir), views.processes(spark, sf_dir))
    return links.select("loop", F.col("blocking").alias("head")).join(links.select("loop", F.col("blocked").alias("head")), ["loop", "head"], "left_anti").distinct()


@_query(
    "blocking_samples",
    _blocked("""SELECT inputbuf_fingerprint, report_id, captured_at, place FROM (SELECT p.inputbuf_fingerprint, r.report_id, r.captured_at, CAST(row_number() OVER (PARTITION BY p.inputbuf_fingerprint ORDER BY r.captured_at, r.report_id) AS INTEGER) AS place
    FROM processes p JOIN reports r ON p.report_id = r.report_id WHERE role = 'blocking' AND inputbuf_fingerprint IS NOT NULL) x WHERE place <= 5"""),
)
def blocking_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.processes(spark, sf_dir)
    return blocking.samples(views.reports(spark, sf_dir), p, p.where("inputbuf_fingerprint IS NOT NULL")).select("inputbuf_fingerprint", "report_id", "captured_at", "place")


@_query("blocking_report_load", _blocked("SELECT r.report_id, r.monitor_loop, a.spid AS blocked_spid, a.wait_time_us, b.spid AS blocking_spid, b.inputbuf_fingerprint FROM reports r JOIN processes a ON a.report_id = r.report_id AND a.role = 'blocked' JOIN processes b ON b.report_id = r.report_id AND b.role = 'blocking'"))
def blocking_report_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.report_rows(views.reports(spark, sf_dir), views.processes(spark, sf_dir)).select("report_id", "monitor_loop", F.col("blocked.spid").alias("blocked_spid"), "blocked.wait_time_us", F.col("blocking.spid").alias("blocking_spid"), "blocking.inputbuf_fingerprint")


# Exports.
_FROM, _TO = "2024-01-08 00:00:00", "2024-01-22 00:00:00"


def _window() -> tuple:
    return F.lit(_FROM).cast("timestamp_ntz"), F.lit(_TO).cast("timestamp_ntz")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.sha2(F.lit("select * from dbo.click where k = ?"), 256)).first()[0]
    return export.candidates(views.reports(spark, sf_dir), *_window(), 2, wanted, views.processes(spark, sf_dir))


_CANDIDATES = f"""FROM reports r WHERE captured_at >= TIMESTAMP '{_FROM}' AND captured_at < TIMESTAMP '{_TO}' AND database_id = 2
  AND EXISTS (SELECT 1 FROM processes p WHERE p.report_id = r.report_id AND p.inputbuf_fingerprint = sha256('select * from dbo.click where k = ?'))"""


@_query("export_blocking", _blocked(f"SELECT report_id, captured_at, monitor_loop, database_id, raw_xml {_CANDIDATES} AND raw_xml IS NOT NULL ORDER BY captured_at, report_id LIMIT 100"))
def export_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.selection(_candidates(spark, sf_dir)).select("report_id", "captured_at", "monitor_loop", "database_id", "raw_xml")


@_query("export_counts", _blocked(f"SELECT count(*) FILTER (WHERE raw_xml IS NOT NULL) AS matched, count(*) FILTER (WHERE raw_xml IS NULL) AS skipped {_CANDIDATES}"))
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.counts(_candidates(spark, sf_dir))


@_query("export_deadlocks", "SELECT event_id AS report_id, ts AS captured_at, '<deadlock id=''' || CAST(event_id AS VARCHAR) || '''/>' AS graph_xml FROM events WHERE event_id % 17 = 0 AND event_id % 2 = 1 ORDER BY ts, event_id LIMIT 100")
def export_deadlocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.selection(_deadlocks(spark, sf_dir), "deadlock").select("report_id", "captured_at", "graph_xml")


# Query history: orders are intervals, lineitems their runtime rows.
def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    intervals = orders.select(F.col("o_orderkey").alias("runtime_stats_interval_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("start_time"), (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("end_time"))
    return items, intervals


_PERIOD = ("1995-03-01 12:00:00", "1995-03-15 12:00:00")


@_query(
    "history_runtime_stats",
    f"""SELECT l_linenumber AS runtime_stats_id, l_orderkey AS runtime_stats_interval_id, CAST(round(l_quantity / 8 * 1000) AS BIGINT) AS avg_duration, CAST(trunc(l_extendedprice) AS BIGINT) AS avg_rowcount, l_tax * 1000 AS stdev_duration, CAST(NULL AS BIGINT) AS avg_log_bytes_used
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '{_PERIOD[1]}' AND o_orderdate + INTERVAL 1 DAY > TIMESTAMP '{_PERIOD[0]}'""",
)
def history_runtime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, intervals = _history(spark, sf_dir)
    runtime = items.select(F.col("l_linenumber").alias("runtime_stats_id"), F.col("l_orderkey").alias("runtime_stats_interval_id"), (F.col("l_quantity") / 8).alias("avg_duration"), F.col("l_extendedprice").alias("avg_rowcount"), F.col("l_tax").alias("stdev_duration"))
    start, end = (F.lit(x).cast("timestamp_ntz") for x in _PERIOD)
    return querystore.runtime_stats(runtime, intervals, start, end, "13.0").select("runtime_stats_id", "runtime_stats_interval_id", "avg_duration", "avg_rowcount", "stdev_duration", "avg_log_bytes_used")


@_query(
    "history_texts_in_window",
    f"""SELECT c_custkey AS query_text_id, c_name AS query_sql_text FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '{_PERIOD[1]}' AND o_orderdate + INTERVAL 1 DAY > TIMESTAMP '{_PERIOD[0]}')""",
)
def history_texts_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, intervals = _history(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    texts = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("query_text_id"), F.col("c_name").alias("query_sql_text"))
    queries = orders.select(F.col("o_custkey").alias("query_text_id"), F.col("o_orderkey").alias("query_id"))
    plans = orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("plan_id"))
    runtime = items.select(F.col("l_orderkey").alias("plan_id"), F.col("l_orderkey").alias("runtime_stats_interval_id"))
    start, end = (F.lit(x).cast("timestamp_ntz") for x in _PERIOD)
    return querystore.texts_in_window(texts, queries, plans, runtime, intervals, start, end)


def history_views(spark: SparkSession, sf_dir: str):
    """Stand-ins of the history's views: a customer is a text, an order a query, its plan and its interval, a line item a runtime row and a wait."""
    items, intervals = _history(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = lambda column, name, unit: [(F.col(column) / d).alias(f"{p}_{name}{unit}") for p, d in (("total", 1), ("avg", 8), ("min", 16), ("max", 2), ("last", 3), ("stdev", 10))]
    views = {
        "query_store_query_text": lambda: spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("query_text_id"), F.col("c_name").alias("query_sql_text")),
        "query_store_query": lambda: orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("query_text_id"), F.col("o_orderdate").alias("last_execution_time"), (F.col("o_orderkey") % 9).alias("count_compiles"), F.col("o_orderpriority").alias("query_parameterization_type_desc")),
        "query_store_plan": lambda: orders.select(F.col("o_orderkey").alias("plan_id"), F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 2 == 0).alias("is_parallel_plan"), F.lit(150).alias("compatibility_level"), F.concat(F.lit("<plan id='"), F.col("o_orderkey").cast("string"), F.lit("'/>")).alias("query_plan")),
        "query_store_runtime_stats": lambda: items.select(F.col("l_linenumber").alias("runtime_stats_id"), F.col("l_orderkey").alias("plan_id"), F.col("l_orderkey").alias("runtime_stats_interval_id"), (F.col("l_quantity") / 8).alias("avg_duration"), F.lit("Regular").alias("execution_type_desc"), F.lit(3).alias("count_executions")),
        "query_store_runtime_stats_interval": lambda: intervals,
        "query_store_wait_stats": lambda: items.select(F.col("l_linenumber").alias("wait_stats_id"), F.col("l_orderkey").alias("plan_id"), F.col("l_orderkey").alias("runtime_stats_interval_id"), F.col("l_returnflag").alias("wait_category_desc"), F.col("l_linestatus").alias("execution_type_desc"), *parts("l_quantity", "query_wait_time", "_ms")),
        "database_query_store_options": lambda: spark.createDataFrame([("READ_WRITE", "READ_WRITE")], "actual_state_desc string, desired_state_desc string"),
    }
    return lambda name: views[name]() if name in views else None


def _extracts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from datetime import datetime

    from ..sources import history

    return history.extracts(history_views(spark, sf_dir), tuple(map(datetime.fromisoformat, _PERIOD)), "15.0")


_ACTIVE = f"SELECT 1 FROM orders o JOIN lineitem ON l_orderkey = o.o_orderkey WHERE o.o_orderdate < TIMESTAMP '{_PERIOD[1]}' AND o.o_orderdate + INTERVAL 1 DAY > TIMESTAMP '{_PERIOD[0]}'"


@_query("history_queries_in_window", f"SELECT o_orderkey AS query_id, o_custkey AS query_text_id, CAST(o_orderkey % 9 AS BIGINT) AS count_compiles, o_orderpriority AS query_parameterization_type, false AS is_internal_query, CAST(o_orderdate AS TIMESTAMP) AS last_execution_time FROM orders q WHERE EXISTS ({_ACTIVE} AND o.o_orderkey = q.o_orderkey)")
def history_queries_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracts(spark, sf_dir)["qds_queries"].select("query_id", "query_text_id", "count_compiles", "query_parameterization_type", "is_internal_query", "last_execution_time")


@_query("history_plans_in_window", f"SELECT o_orderkey AS plan_id, o_orderkey AS query_id, (o_orderkey % 2 = 0) AS is_parallel_plan, false AS is_forced_plan, 150 AS compatibility_level, '<plan id=' || chr(39) || CAST(o_orderkey AS VARCHAR) || chr(39) || '/>' AS query_plan FROM orders q WHERE EXISTS ({_ACTIVE} AND o.o_orderkey = q.o_orderkey)")
def history_plans_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracts(spark, sf_dir)["qds_plans"].select("plan_id", "query_id", "is_parallel_plan", "is_forced_plan", "compatibility_level", "query_plan")


@_query(
    "history_wait_stats",
    f"""SELECT CAST(l_linenumber AS INTEGER) AS wait_stats_id, l_orderkey AS plan_id, l_returnflag AS wait_category, l_linestatus AS execution_type, CAST(round(l_quantity * 1000) AS BIGINT) AS total_query_wait_time_us, CAST(round(l_quantity / 8 * 1000) AS BIGINT) AS avg_query_wait_time_us, CAST(round(l_quantity / 2 * 1000) AS BIGINT) AS max_query_wait_time_us, round(l_quantity / 10 * 1000, 6) AS stdev_query_wait_time_us
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '{_PERIOD[1]}' AND o_orderdate + INTERVAL 1 DAY > TIMESTAMP '{_PERIOD[0]}'""",
)
def history_wait_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _extracts(spark, sf_dir)["qds_wait_stats"]
    return rounded(rows.select("wait_stats_id", "plan_id", "wait_category", "execution_type", "total_query_wait_time_us", "avg_query_wait_time_us", "max_query_wait_time_us", "stdev_query_wait_time_us"), stdev_query_wait_time_us=6)


_ROWS = f"SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '{_PERIOD[1]}' AND o_orderdate + INTERVAL 1 DAY > TIMESTAMP '{_PERIOD[0]}'"


@_query(
    "history_run_counts",
    f"""SELECT 'qds_query_text' AS name, (SELECT count(*) FROM customer c WHERE EXISTS ({_ACTIVE} AND o.o_custkey = c.c_custkey)) AS cnt UNION ALL SELECT 'qds_queries', (SELECT count(*) FROM orders q WHERE EXISTS ({_ACTIVE} AND o.o_orderkey = q.o_orderkey))
    UNION ALL SELECT 'qds_plans', (SELECT count(*) FROM orders q WHERE EXISTS ({_ACTIVE} AND o.o_orderkey = q.o_orderkey)) UNION ALL SELECT 'qds_runtime_stats', ({_ROWS}) UNION ALL SELECT 'qds_wait_stats', ({_ROWS})""",
)
def history_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each table of an import gets, as the run's row tells them."""
    counts = [rows.agg(F.count("*").alias("cnt")).select(F.lit(name).alias("name"), "cnt") for name, rows in _extracts(spark, sf_dir).items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out


@_query("ingest_filter", f"WITH {EXECUTIONS_SQL} SELECT database_name, count(*) AS cnt FROM executions WHERE lower(database_name) IN ('db1', 'db2') AND NOT coalesce(lower(login_name) <> 'login1', false) GROUP BY 1")
def ingest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("database_name", "in", values=("DB1", "DB2"), stage="ingest"), Rule("login_name", "neq", "LOGIN1", stage="ingest", action="exclude"), Rule("duration_us", "gt", "0", stage="ingest", action="exclude")]
    return views.executions(spark, sf_dir).where(filters.ingest(rules)).groupBy("database_name").agg(F.count("*").alias("cnt"))


# Without SQL: parsers, documents and tokens.
@_query("blocking_xml_parse")
def blocking_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.xmlreports import parse_blocking

    rows = raw_events(spark, sf_dir).where("name = 'blocked_process_report'").select("file_offset", F.col("fields")["blocked_process"].alias("xml"))
    return parse_blocking(rows, "xml").select("file_offset", "report.*").select("file_offset", "monitor_loop", "database_id", F.col("blocked.spid").alias("blocked_spid"), F.col("blocked.wait_time_us").alias("wait_time_us"), F.col("blocked.object_id").alias("object_id"), F.col("blocked.inputbuf").alias("inputbuf"), F.col("blocking.spid").alias("blocking_spid"))


ORACLES["blocking_xml_parse"] = """SELECT event_id AS file_offset, CAST(event_id % 9 AS INTEGER) AS monitor_loop, 5 AS database_id, CAST(event_id % 50 AS INTEGER) AS blocked_spid, (event_id % 100) * 1000 AS wait_time_us, CAST(1977058079 AS BIGINT) AS object_id,
  'exec dbo.' || event_type || ' @k = ' || json_extract_string(props, '$.k') || ', @s = N''it''''s''' AS inputbuf, 7 AS blocking_spid FROM events WHERE event_id % 13 = 0"""


@_query("deadlock_parse", "SELECT event_id AS file_offset, CAST(event_id % 50 AS VARCHAR) AS participant_spids, '' AS victim_spids FROM events WHERE event_id % 17 = 0 AND event_id % 13 <> 0")
def deadlock_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.xmlreports import parse_deadlock

    rows = raw_events(spark, sf_dir).where("name = 'xml_deadlock_report'").select("file_offset", F.col("fields")["xml_report"].alias("xml"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return parse_deadlock(rows, "xml").select("file_offset", joined("participant_spids"), joined("victim_spids"))


def _items(section: str, fields: str, source: str) -> str:
    """SQL for a section of the digest: its items' fields, joined by bars; null fields are empty."""
    text = " || '|' || ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields.split(", "))
    return f"SELECT '{section}' AS section, {text} AS line FROM ({source}) x"


def _statements(role: str) -> str:
    return f"SELECT inputbuf_fingerprint AS f, coalesce(s.normalized_sql, inputbuf, '(none)') AS t, count(*) AS cnt FROM processes p LEFT JOIN signatures s ON p.inputbuf_fingerprint = s.normalized_hash WHERE role = '{role}' AND inputbuf_fingerprint IS NOT NULL GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 10"


def _grouped(column: str, where: str = "", limit: str = "") -> str:
    return f"SELECT coalesce(CAST({column} AS VARCHAR), '(none)') AS key, count(*) AS cnt FROM processes WHERE role = 'blocked' {where} GROUP BY 1 ORDER BY cnt DESC, key {limit}"


_DIGEST = " UNION ALL ".join(
    [
        _items("Overview", "a, b, c, d", "SELECT (SELECT count(*) FROM reports) AS a, (SELECT count(*) FROM events WHERE event_id % 17 = 0) AS b, (SELECT min(captured_at) FROM reports) AS c, (SELECT max(captured_at) FROM reports) AS d"),
        _items("Locality", "t, cnt, pct", "SELECT wait_resource_type AS t, count(*) AS cnt, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS DECIMAL(12, 6)) AS pct FROM processes WHERE role = 'blocked' GROUP BY 1"),
        _items("TopObjects", "key, cnt", _grouped("object_id", "AND object_id IS NOT NULL", "LIMIT 10")), _items("LockModes", "key, cnt", _grouped("lock_mode")), _items("IsolationLevels", "key, cnt", _grouped("isolation_level")),
        _items("TopBlockers", "f, t, cnt", _statements("blocking")), _items("TopBlocked", "f, t, cnt", _statements("blocked")),
        _items("WaitTimes", "a, b, c", "SELECT CAST(trunc(quantile_cont(wait_time_us, 0.5)) AS BIGINT) AS a, CAST(trunc(quantile_cont(wait_time_us, 0.95)) AS BIGINT) AS b, max(wait_time_us) AS c FROM processes WHERE role = 'blocked'"),
        _items("Chains", "loop, depth, head, edges", "SELECT * FROM chains"),
        _items("Samples", "f, place, report_id, captured_at", f"SELECT * FROM (SELECT p.inputbuf_fingerprint AS f, r.report_id, r.captured_at, row_number() OVER (PARTITION BY p.inputbuf_fingerprint ORDER BY r.captured_at, r.report_id) AS place FROM processes p JOIN reports r ON p.report_id = r.report_id WHERE role = 'blocking' AND p.inputbuf_fingerprint IN (SELECT f FROM ({_statements('blocking')}) t)) y WHERE place <= 5"),
    ]
)


@_query("blocking_digest", f"WITH {BLOCKING_SQL}, chains AS ({ORACLES['blocking_chains']}) {_DIGEST}")
def blocking_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import digest

    return digest.lines(digest.build(views.reports(spark, sf_dir), views.processes(spark, sf_dir), _deadlocks(spark, sf_dir), views.signatures(spark, sf_dir)))


def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each nation: its name is the table, its region's number the schema."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    xml = F.format_string("<Plan><Stmt StatementText=\"SELECT * FROM %s WHERE k = %s\"/><Object Schema='[r%s]' Table='[%s]'/></Plan>", "n_name", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), "n_name")
    return nation.select(F.col("n_nationkey").alias("plan_id"), xml.alias("xml"))


@_query(
    "anonymous_names",
    """WITH f AS (SELECT DISTINCT 'Table' AS kind, n_name AS original_name FROM nation UNION SELECT DISTINCT 'Schema', 'r' || CAST(n_regionkey AS VARCHAR) FROM nation)
    SELECT kind, original_name, kind || CAST(row_number() OVER (PARTITION BY kind ORDER BY lower(original_name)) AS VARCHAR) AS token FROM f""",
)
def anonymous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import anonymize

    return anonymize.names(plan_documents(spark, sf_dir))


@_query(
    "anonymous_plans",
    """WITH s AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS r, 'Schema' || CAST(dense_rank() OVER (ORDER BY 'r' || CAST(n_regionkey AS VARCHAR)) AS VARCHAR) AS st, 'Table' || CAST(row_number() OVER (ORDER BY lower(n_name)) AS VARCHAR) AS tt, n_nationkey FROM nation)
    SELECT n_nationkey AS plan_id, '<Plan><Stmt StatementText="SELECT * FROM ' || tt || ' WHERE k = ?" /><Object Schema="[' || st || ']" Table="[' || tt || ']" /></Plan>' AS anon_xml FROM s""",
)
def anonymous_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import anonymize

    plans = plan_documents(spark, sf_dir)
    return anonymize.anonymized(plans, anonymize.names(plans)).select("plan_id", "anon_xml")
