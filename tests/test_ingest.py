from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracelake.operators import workload
from tracelake.operators.filters import Rule
from tracelake.sources.ingest import RAW, tables
from tracelake.sources.project import Project

BLOCKED = """<blocked-process-report monitorLoop="42"><blocked-process><process spid="201" waitresource="KEY: 5:72057594041204736 (81)" waittime="5972" lockMode="S" trancount="2"><inputbuf>
 select 'secret </inputbuf></process></blocked-process><blocking-process><process spid="118"><inputbuf>update t set a = 1</inputbuf></process></blocking-process></blocked-process-report>"""


def event(n, name, fields, actions=None):
    return (name, datetime(2026, 1, 1, 0, n), fields, actions or {"database_name": "Sales", "session_id": "7"}, "a", n)


EVENTS = [
    event(0, "sql_batch_completed", {"batch_text": "select * from dbo.A where x = 1", "duration": "1000"}),
    event(1, "sql_batch_completed", {"batch_text": "select * from dbo.A where x = 2", "duration": "3000"}),
    event(2, "sql_batch_completed", {"batch_text": "select * from dbo.B", "duration": "500"}, {"database_name": "tempdb"}),
    event(3, "rpc_completed", {"statement": "exec p @id = 5, @token = abc", "duration": "9", "object_name": "p"}),
    event(4, "login", {}),
    event(5, "blocked_process_report", {"blocked_process": BLOCKED}),
    event(6, "blocked_process_report", {"blocked_process": "<broken"}),
    event(7, "blocked_process_report", {"blocked_process": "<blocked-process-report/>"}),
    event(8, "xml_deadlock_report", {"xml_report": "<d><x><process spid='1'/></x><process spid='2'/><process spid='1'/></d>"}),
    event(9, "xml_deadlock_report", {"xml_report": "no xml"}),
]


@pytest.mark.parametrize("mode", ["masked", "off"])
def test_tables(spark, mode):
    raw = spark.createDataFrame(EVENTS, RAW).repartition(3)
    got = tables(raw, redaction=mode, rules=[Rule("database_name", "eq", "TEMPDB", stage="ingest", action="exclude")])
    run = got["ingestion_runs"].first()
    assert (run.events_read, run.events_mapped, run.events_unmapped, run.events_cleaned, run.events_blocking, run.events_deadlocks, run.blocking_parse_failures) == (10, 3, 1, 1, 1, 1, 3)
    assert sorted((r.execution_id, r.file_offset) for r in got["executions"].collect()) == [(1, 0), (2, 1), (3, 3)]
    (a,) = [r for r in got["normalized_queries"].collect() if r.primary_table == "dbo.A"]
    assert (a.statement_kind, a.first_seen_at, a.last_seen_at) == ("SELECT", datetime(2026, 1, 1, 0, 0), datetime(2026, 1, 1, 0, 1))
    both = {r.role: r for r in got["blocking_processes"].collect()}
    assert (both["blocked"].spid, both["blocked"].wait_time_us, both["blocked"].wait_resource_type, both["blocked"].trancount) == (201, 5_972_000, "Key", 2)
    assert both["blocked"].inputbuf_fingerprint and ("secret" in both["blocked"].inputbuf) == (mode == "off")
    report, dead = got["blocking_reports"].first(), got["deadlock_reports"].first()
    assert (report.monitor_loop, report.database_id) == (42, 5) and (report.raw_xml is None) == (mode == "masked")
    assert (dead.participant_spids, dead.victim_spids, dead.graph_xml == "<redacted/>") == ("1,2", "", mode == "masked")
    values = {r.name: r.value_text for r in got["execution_parameters"].collect()}
    assert values.keys() == (set() if mode == "off" else {"@id", "@token"}) and values.get("@id", "*") == "*"


def test_project_round_trip(spark, tmp_path):
    landing = tmp_path / "landing"
    spark.createDataFrame(EVENTS, RAW).coalesce(1).write.parquet(str(landing))
    project = Project(spark, str(tmp_path / "p"))
    first, second = project.import_events(str(landing)), project.import_events(str(landing))
    assert (first["run_id"], second["run_id"], second["events_mapped"]) == (1, 2, 4)
    top = workload.top_statements(project.signed(), 1).first()
    assert (top.primary_table, top.cnt, top.total_us) == ("dbo.A", 4, 8000)
    assert project.table("executions").agg(F.max("execution_id")).first()[0] == 8
    assert project.table("normalized_queries").count() == 3
