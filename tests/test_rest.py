from datetime import datetime

import pytest

from tracelake.operators import anonymize
from tracelake.operators.querystore import has_recent, metric_columns, parse_window
from tracelake.sources.ingest import RAW
from tracelake.sources.plans import anonymize_folder, save_plan
from tracelake.streaming import live

PLAN = """<?xml version="1.0" encoding="utf-16"?>
<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan"><StmtSimple StatementText="SELECT o.Total FROM [Sales].dbo.Orders o WHERE o.Name = 'Ann' AND o.Id = @p AND @@ROWCOUNT > 0x1F -- note"><Object Database="[Sales]" Schema="[dbo]" Table="[Orders]" Alias="[o]"/><ColumnReference Column="Total"/><ColumnReference Column="Id"/><ColumnReference Column="Name"/><ColumnReference Column="@p" ParameterCompiledValue="(42)"/><Object Database="[Sales]" Schema="[sys]" Table="[objects]"/><Object Table="[#work________00AB]"/><Object Table="[#work]"/></StmtSimple><StmtSimple StatementText="CREATE PROC dbo.Hidden AS SELECT 'cut"/></ShowPlanXML>"""


def test_plans_leak_nothing():
    names = anonymize.Names()
    out = anonymize.anonymize(PLAN, names)
    for secret in ("Orders", "Total", "Sales", "Ann", "42", "note", "Hidden", "cut", "work", "0x1F"):
        assert secret not in out
    assert "[sys]" in out and "@@ROWCOUNT" in out and out.startswith('<?xml version="1.0" encoding="utf-8"?>') and out.count("#Temp1") == 2
    assert anonymize.anonymize(PLAN, anonymize.Names.from_json(names.to_json())) == out
    again = anonymize.Names.of([*names.rows(), ("Odd", "x", "y")])
    assert again.token("Table", "fresh") == f"Table{names.counts['Table'] + 1}" and again.token("Table", "[ORDERS]") == "Table1"


def test_names_that_texts_define():
    def found(sql):
        names = anonymize.Names()
        anonymize._defined(sql, names)
        return sorted((k, n) for k, n, _ in names.rows())

    assert found("CREATE OR ALTER PROCEDURE [Sales DB].dbo.Hidden AS SELECT 1") == [("Database", "Sales DB"), ("Schema", "dbo"), ("Table", "Hidden")]
    assert found("alter /* x */ view v as select 1; CREATE UNIQUE NONCLUSTERED INDEX ix ON t (a)") == [("Index", "ix"), ("Table", "v")]
    assert found('CREATE STATISTICS st ON t (a) CREATE SCHEMA "s" ALTER SCHEMA other TRANSFER x') == [("Schema", "s"), ("Statistics", "st")]
    assert found("create table #work____0AF1 (a int) -- CREATE TABLE gone\nselect 'CREATE TABLE quoted'") == [("TempTable", "#work")]
    assert found("CREATE FUNCTION srv.db.sch.f() RETURNS int AS BEGIN RETURN 'cut") == [("Database", "db"), ("Schema", "sch"), ("Table", "f")]
    assert found("CREATE") == found("alter table") == found("create login x") == []
    assert [anonymize.temp_name(n) for n in ("#a____0F", "#a___0F", "#a____xyz", "b____0F", "#a")] == ["#a", "#a___0F", "#a____xyz", "b____0F", "#a"]


def test_folder_keeps_going(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.SQLPLAN").write_text(PLAN, encoding="utf-16")
    (tmp_path / "in" / "deep" / "b.sqlplan").write_text("<broken", encoding="utf-8")
    errors = anonymize_folder(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "map.json"))
    assert len(errors) == 1 and (tmp_path / "out" / "a.anon.sqlplan").exists()
    with pytest.raises(ValueError):
        anonymize_folder(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "out" / "map.json"))
    with pytest.raises(ValueError):
        save_plan(str(tmp_path), "../x", "<a/>")


def test_windows():
    now = datetime(2026, 1, 3)
    assert parse_window(last="24h", now=now) == (datetime(2026, 1, 2), now) and parse_window() == (None, None)
    for bad in ({"last": "0h"}, {"last": "3w"}, {"last": "1d", "start": "2026-01-01"}, {"start": "2026-01-02", "end": "2026-01-01"}):
        with pytest.raises(ValueError):
            parse_window(**bad)
    assert [has_recent(v) for v in (None, "13.0", "14.0", "odd")] == [True, False, True, False] and len(metric_columns()) == 55


def test_stream_counts_each_event_once(spark, tmp_path):
    rows = [("rpc_completed", datetime(2026, 1, 1, 0, n), {"statement": "exec p @a = 1", "duration": "5"}, {}, "f", n) for n in (0, 1, 1, 2)]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "in"))
    query = live.once(live.landed_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 3
