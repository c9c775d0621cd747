import json
from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from tracelake.operators import blocking, digest, export

PROCESS = "report_id long, role string, spid int, wait_time_us long, wait_resource_type string, object_id long, lock_mode string, isolation_level string, inputbuf string, inputbuf_fingerprint string"


def tables(spark, links):
    """reports and processes of (loop, blocking, blocked) links."""
    reports = spark.createDataFrame([(i, datetime(2026, 1, 1 + i % 20), loop, 5, None if i % 2 else "<x/>") for i, (loop, _, _) in enumerate(links)], "report_id long, captured_at timestamp_ntz, monitor_loop int, database_id int, raw_xml string")
    rows = []
    for i, (_, a, b) in enumerate(links):
        rows += [(i, "blocked", b, 5_000_000, "Object", 7, None, "rc", "wait", "f"), (i, "blocking", a, 0, "Object", 7, "X", "rc", "hold", "g")]
    return reports, spark.createDataFrame(rows, PROCESS)


@pytest.mark.parametrize("size", [100_000, 0])
def test_chains(spark, size):
    links = [(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 1, 2), (2, 9, 8), (None, 5, 6), (3, 1, 2), (3, 2, 1)]
    links += [(99, 100, 200), (99, 200, 300), (99, 300, 200)]  # a cycle below a head
    got = {(r.loop, r.head): (r.depth, r.edges) for r in blocking.chains(*tables(spark, links), loop_size=size).collect()}
    want = {(1, 1): (3, 4), (2, 9): (2, 1), (None, 5): (1, 0)}
    assert got == want | {(99, 100): (64, 3)}


@pytest.mark.parametrize("size", [100_000, 0])
def test_chains_with_nulls(spark, size):
    """Either way gives what the query's SQL gives for the same links."""
    links = [(1, 1, None), (2, 1, 2), (2, 2, None), (3, 1, 2), (3, None, 1), (4, None, 3), (4, 3, 4), (5, None, None), (6, 1, None), (6, 1, 2)]
    got = sorted(tuple(map(str, r)) for r in blocking.chains(*tables(spark, links), loop_size=size).select("loop", "head", "depth", "edges").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE given (loop INTEGER, blocking INTEGER, blocked INTEGER)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?)", links)
    walk = __spark_entry__.oracle_sql()["blocking_chains"].split("heads AS", 1)[1]
    want = con.execute("WITH RECURSIVE links AS (SELECT * FROM given), heads AS" + walk).fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want) and ("1", "1", "2", "1") in got


def test_rollups_and_digest(spark):
    reports, processes = tables(spark, [(1, 118, 200), (1, 118, 201)])
    signatures = spark.createDataFrame([("g", "select hold")], "normalized_hash string, normalized_sql string")
    dead = spark.createDataFrame([], "report_id long, captured_at timestamp_ntz, graph_xml string")
    row = digest.build(reports, processes, dead, signatures).first()
    assert (row.blocking_reports, row.deadlock_reports, row.max_us) == (2, 0, 5_000_000)
    assert [tuple(x) for x in row.top_blockers] == [("g", "select hold", 2)] and row.top_blocked[0].display_sql == "wait"
    assert [tuple(x) for x in row.locality] == [("Object", 2, 100.0)] and len(row.samples) == 2
    assert "select hold" in digest.as_markdown(digest.build(reports, processes, dead, signatures))
    empty = blocking.wait_times(processes.limit(0)).first()
    assert tuple(empty) == (0.0, 0.0, 0)


def test_digest_has_every_chain(spark):
    reports, processes = tables(spark, [(i, 1, 2) for i in range(150)] + [(7, 2, 3), (None, 5, 6)])
    none = spark.createDataFrame([], "normalized_hash string, normalized_sql string")
    dead = spark.createDataFrame([], "report_id long, captured_at timestamp_ntz, graph_xml string")
    want = [tuple(r) for r in blocking.chains(reports, processes).collect()]
    built = digest.build(reports, processes, dead, none)
    assert [tuple(c) for c in built.first().chains] == want and want[0] == (7, 1, 3, 2) and len(want) == 151
    document = json.loads(digest.as_json(built).first()[0])
    assert document["SchemaVersion"] == 1 and list(document["Digest"]) == list(digest.SECTIONS)
    assert len(document["Digest"]["Chains"]) == 151 and document["Digest"]["Chains"][0] == {"MonitorLoop": 7, "Depth": 3, "HeadSpid": 1, "EdgeCount": 2}
    assert document["Digest"]["Overview"]["ReportCount"] == 152 and document["Digest"]["LockModes"][0]["Key"] == "(none)"
    assert "| 149 | 1 | 2 | 1 |" in digest.as_markdown(built)
    assert digest.build(reports.limit(0), processes, dead, none).first().chains == []


def test_export_files(spark, tmp_path):
    reports, processes = tables(spark, [(1, 1, 2)] * 5)
    rows = export.candidates(reports, fingerprint="g", processes=processes)
    assert tuple(export.counts(rows).first()) == (3, 2)
    entries = export.write_files(export.selection(rows, limit=2), str(tmp_path))
    assert [e["report_id"] for e in entries] == [0, 2] and (tmp_path / "index.json").exists() and (tmp_path / entries[0]["file"]).read_text() == "<x/>"
    with pytest.raises(ValueError):
        export.write_files(rows, "a/../b")
