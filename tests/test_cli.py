import json
from datetime import datetime

from test_ingest import EVENTS
from test_rest import PLAN

from tracelake import cli
from tracelake.functions.progress import Estimator, Tracker, short
from tracelake.operators.presenters import DrillDown, TopSlow, chosen
from tracelake.sources.ingest import RAW
from tracelake.sources.plans import default_map_path
from tracelake.sources.project import Project


def landed(spark, tmp_path):
    spark.createDataFrame(EVENTS, RAW).coalesce(1).write.parquet(f"{tmp_path}/landing")
    return f"{tmp_path}/landing"


def test_import_top_slow_and_exports(spark, tmp_path, capsys):
    at, source = f"{tmp_path}/p", landed(spark, tmp_path)
    assert cli.main(["import", source, "--project", at]) == 0
    run = Project(spark, at).table("ingestion_runs").first()
    assert (run.source_path, run.files_count) == (source, 1) and run.bytes_total > 0 and run.started_at <= run.finished_at and run.redaction_policy == "masked"
    (tmp_path / "p" / "config.json").write_text(json.dumps({"display": {"durationUnit": "us"}, "ingest": {"redactionPolicy": "off"}, "server": {"connectionString": "x=${NOT_THERE};"}}))
    capsys.readouterr()
    assert cli.main(["top-slow", "--project", at, "--limit", "1"]) == 0
    line = capsys.readouterr().out
    assert "4000 us" in line and "dbo.A" in line
    assert Project(spark, at).config()["server.connectionString"] == "x=;"
    assert cli.main(["import", source, "--project", at]) == 0  # the configured redaction
    runs = {r.run_id: r.redaction_policy for r in Project(spark, at).table("ingestion_runs").collect()}
    assert runs == {1: "masked", 2: "off"} and Project(spark, at).table("normalized_queries").count() == 3
    assert cli.main(["export-blocking", "--project", at, "--out", f"{tmp_path}/out", "--full"]) == 0
    document = json.loads((tmp_path / "out" / "blocking.json").read_text())
    assert document["SchemaVersion"] == 1 and document["Digest"]["Overview"]["ReportCount"] == 2
    assert "Blocking digest" in (tmp_path / "out" / "blocking.md").read_text() and list((tmp_path / "out" / "full").glob("part-*"))
    assert cli.main(["export-events", "--project", at, "--out", f"{tmp_path}/ev", "--kind", "deadlock"]) == 0
    assert len(json.loads((tmp_path / "ev" / "index.json").read_text())) == 1  # the masked one can't be exported


def test_half_written_copies_are_not_read(spark, tmp_path):
    project = Project(spark, f"{tmp_path}/p")
    project.rewrite("normalized_queries", spark.range(3).withColumnRenamed("id", "normalized_hash"))
    (tmp_path / "p" / "tables" / "normalized_queries.v9").mkdir()
    assert project.table("normalized_queries").count() == 3
    project.rewrite("normalized_queries", spark.range(4).withColumnRenamed("id", "normalized_hash"))
    assert project.table("normalized_queries").count() == 4


def test_plans_of_a_project_share_its_map(spark, tmp_path):
    project = Project(spark, f"{tmp_path}/p")
    (tmp_path / "p" / "plans").mkdir()
    for name in ("a", "b"):
        (tmp_path / "p" / "plans" / f"{name}.sqlplan").write_text(PLAN.replace("utf-16", "utf-8"))
    assert cli.main(["obfuscate-plan", "--project", project.path, "--plan-id", "a"]) == 0
    first = project.table("obfuscation_map").collect()
    assert cli.main(["obfuscate-plan", "--project", project.path, "--plan-id", "b"]) == 0
    assert sorted(project.table("obfuscation_map").collect()) == sorted(first)
    texts = [(tmp_path / "p" / "plans" / f"{n}.anon.sqlplan").read_text() for n in ("a", "b")]
    assert texts[0] == texts[1] and "Orders" not in texts[0]
    (tmp_path / "one.sqlplan").write_text(PLAN.replace("utf-16", "utf-8"))
    assert cli.main(["obfuscate-plan", "--in", f"{tmp_path}/one.sqlplan", "--out", f"{tmp_path}/two.sqlplan"]) == 0
    assert (tmp_path / "two.map.json").exists() and "Orders" not in (tmp_path / "two.sqlplan").read_text()
    assert default_map_path("/x/out/") == "/x/out.map.json"
    assert cli.main(["anonymize-plans", f"{tmp_path}/p/plans", f"{tmp_path}/folder"]) == 0 and (tmp_path / "folder.map.json").exists()


def test_presenters(spark):
    when = datetime(2026, 1, 1)
    rows = [("h1", "SELECT", "t", "select a", 1, when, 5000), ("h1", "SELECT", "t", "select a", 2, when, 3000), ("h2", "EXEC", None, "exec b", 3, when, 9000), ("h3", "SELECT", "u", "select fast", 4, when, None)]
    executions = spark.createDataFrame(rows, "normalized_hash string, statement_kind string, primary_table string, normalized_sql string, execution_id long, captured_at timestamp_ntz, duration_us long")
    screen = TopSlow(executions, columns=["TOTAL", "kind"])
    assert [tuple(r) for r in screen.shown().collect()] == [("EXEC", 9000), ("SELECT", 8000), ("SELECT", None)]
    seen = []
    for _ in range(5):
        seen.append(screen.sort)
        screen.next_sort()
    assert seen == ["total", "p95", "max", "avg", "total"]
    screen.set_sort("count")
    assert screen.sort == "p95" and screen.load().first().p95_us == 9000.0
    screen.text, screen.limit = "FAST", 1
    assert [r.normalized_hash for r in screen.load().collect()] == ["h3"]
    assert chosen(["a", "b", "c"], ["C", "A"]) == ["a", "c"] and chosen(["a"], []) == ["a"]
    parameters = spark.createDataFrame([(1, "@p", "x"), (2, "@p", "y")], "execution_id long, name string, value_text string")
    drill = DrillDown(executions, parameters, "h1")
    assert drill.occurrences().count() == 2 and [r.value_text for r in drill.impact("@p").collect()] == ["x", "y"]


def test_progress():
    one = Estimator(1000)
    assert one.estimate(15_000) == 15 and one.estimate(0) == 0 and one.estimate(1) == 1
    one.observe(10, 30_000)
    one.observe(0, 5)
    assert one.estimate(30_000) == 10
    assert [short(n) for n in (999, 1000, 812_345, 1_250_000)] == ["999", "1k", "812k", "1.2M"]
    track = Tracker({"a": 3000, "b": 1000})
    track.read("a", 1)
    assert (track.file_fraction, track.overall_fraction) == (0.5, 0.375)
    track.read("a", 500)
    assert track.file_fraction == 0.99
    track.complete("a", 3)
    track.read("elsewhere", 9)
    assert (track.file_fraction, track.overall_fraction, track.estimator.bytes_per_event) == (1.0, 0.75, 1000)
    assert track.text(read=1500) == "[1/2] a  file 100%  overall 75%  read=1k"
    track.complete("b", 1)
    assert track.overall_fraction == 1.0 and Tracker({}).text() == "  file 0%  overall 0%  "
