"""Queries return rows for their whole tables."""

import duckdb

import __spark_entry__

#: Large enough to have ids and sessions beyond any small range.
SF = "/root/testdata/sf0.01"


def whole(spark, name, sql, sf_dir=SF):
    """The query's rows and those of SQL without a range of ids, both in order."""
    df = __spark_entry__.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = con.execute(sql)
    assert [d[0] for d in want.description] == df.columns
    return sorted(map(str, map(tuple, df.collect()))), sorted(map(str, want.fetchall()))


def test_every_report_is_loaded(spark):
    sql = """SELECT event_id AS report_id, event_id // 8 AS monitor_loop, CAST(event_id % 8 AS INTEGER) AS blocked_spid, CAST(floor(value * 1000) AS BIGINT) AS wait_time_us,
    CAST(user_id % 8 AS INTEGER) AS blocking_spid, CASE WHEN event_id % 11 <> 0 THEN sha256('select * from dbo.' || event_type || ' where k = ?') END AS inputbuf_fingerprint FROM events WHERE event_id % 8 <> 0"""
    got, want = whole(spark, "blocking_report_load", sql)
    assert got == want and len(got) > 2000


def test_executions_of_every_session_are_loaded(spark):
    sql = """SELECT event_id AS execution_id, ts AS captured_at, 'SELECT * FROM dbo.' || event_type || ' WHERE k = ' || json_extract_string(props, '$.k') AS sql_text_raw, '@k=' || json_extract_string(props, '$.k') AS parameters FROM events"""
    got, want = whole(spark, "load_execution", sql)
    assert got == want and len(got) == 10_000
