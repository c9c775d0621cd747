import os
from datetime import datetime

import pytest

from tracelake import cli
from tracelake.plans import catalog
from tracelake.sources import history
from tracelake.sources.project import Project


@pytest.fixture()
def views_folder(spark, sf_dir, tmp_path):
    """The history's views as Parquet tables."""
    views = catalog.history_views(spark, sf_dir)
    for name in history.VIEWS:
        views(name).write.parquet(f"{tmp_path}/views/{name}.parquet")
    return f"{tmp_path}/views"


def test_import_by_command(spark, tmp_path, views_folder, capsys):
    at = f"{tmp_path}/project"
    window = ["--from", "1995-03-01T12:00:00", "--to", "1995-03-15T12:00:00"]
    assert cli.main(["query-store-import", "--project", at, "--views", views_folder, "--database", "Sales", "--version", "13.0.1", *window]) == 0
    said = capsys.readouterr()
    assert "run 1:" in said.out and "literal values" in said.err
    project = Project(spark, at)
    run = project.table("qds_runs").first()
    tables = {name: project.table(name) for name in history.TABLES}
    assert (run.run_id, run.database_name, run.query_store_actual_state, run.wait_stats_available, run.plans_requested, run.window_to) == (1, "Sales", "READ_WRITE", True, True, datetime(1995, 3, 15, 12))
    assert [run.query_text_count, run.queries_count, run.plans_count, run.runtime_stat_rows, run.wait_stat_rows] == [tables[n].count() for n in history.TABLES]
    assert run.plans_count == run.plan_files_written > 0 == run.plan_write_failures
    plan = tables["qds_plans"].first()
    assert plan.plan_written and "query_plan" not in plan.asDict()
    with open(f"{at}/plans/{plan.sqlplan_path}") as text:
        assert text.read() == f"<plan id='{plan.plan_id}'/>"
    stats = tables["qds_runtime_stats"]
    assert stats.where("avg_log_bytes_used IS NOT NULL OR interval_start_time >= TIMESTAMP '1995-03-15 12:00:00'").count() == 0
    # A second import without a window and without plans is a run of its own, with everything.
    assert cli.main(["query-store-import", "--project", at, "--views", views_folder, "--no-plans"]) == 0
    second = project.table("qds_runs").where("run_id = 2").first()
    assert second.query_text_count > run.query_text_count and (second.plan_files_written, second.plans_requested, second.window_from) == (0, False, None)
    assert cli.main(["query-store-import", "--project", at, "--views", views_folder, "--last", "3w"]) == 1


def test_no_history_no_run(spark, tmp_path, views_folder):
    project = Project(spark, f"{tmp_path}/project")
    off = spark.createDataFrame([("OFF", "OFF")], "actual_state_desc string, desired_state_desc string")
    views = history.from_folder(spark, views_folder)
    for states in (off, off.limit(0), None):
        with pytest.raises(ValueError, match="history"):
            history.import_history(project, lambda name, s=states: s if name == "database_query_store_options" else views(name))
    assert project.table("qds_runs") is None
    # Servers that collect no waits.
    row = history.import_history(project, lambda name: None if name == "query_store_wait_stats" else views(name), write_plans=False)
    assert (row["wait_stats_available"], row["wait_stat_rows"]) == (False, 0) and project.table("qds_wait_stats") is None


def test_missing_source(tmp_path):
    assert cli.main(["query-store-import", "--project", str(tmp_path)]) == 1
    assert not os.path.exists(f"{tmp_path}/tables")
