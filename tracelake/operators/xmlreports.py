"""Blocked-process and deadlock reports from their XML.

from_xml in permissive mode gives a struct of nulls for text that is no XML, where XPath functions would fail the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import wait_resource

_PROCESS = "struct<_spid:string,_ecid:string,_status:string,_waitresource:string,_waittime:string,_trancount:string,_lockMode:string,_isolationlevel:string,_clientapp:string,_hostname:string,_loginname:string,inputbuf:string>"
_REPORT = f"_monitorLoop string, `blocked-process` struct<process:{_PROCESS}>, `blocking-process` struct<process:{_PROCESS}>"


def _process(p: Column) -> Column:
    wait = wait_resource(p["_waitresource"])
    return F.struct(
        p["_spid"].try_cast("int").alias("spid"),
        p["_ecid"].try_cast("int").alias("ecid"),
        p["_status"].alias("status"),
        p["_waitresource"].alias("wait_resource_raw"),
        wait["type"].alias("wait_resource_type"),
        wait["object_id"].alias("object_id"),
        wait["hobt_id"].alias("hobt_id"),
        (p["_waittime"].try_cast("int").cast("bigint") * 1000).alias("wait_time_us"),
        p["_lockMode"].alias("lock_mode"),
        p["_isolationlevel"].alias("isolation_level"),
        p["_trancount"].try_cast("int").alias("trancount"),
        p["_clientapp"].alias("client_app"),
        p["_hostname"].alias("host_name"),
        p["_loginname"].alias("login_name"),
        F.trim(p["inputbuf"]).alias("inputbuf"),
    )


def parse_blocking(df: DataFrame, xml: str) -> DataFrame:
    """df with `report`: struct<monitor_loop, database_id, blocked, blocking>, null where the text holds no whole report."""
    parsed = F.from_xml(F.col(xml), _REPORT, {"mode": "PERMISSIVE", "rowTag": "blocked-process-report"})
    out = df.withColumn("_x", parsed)
    blocked, blocking = (F.col(f"_x.`{side}-process`.process") for side in ("blocked", "blocking"))
    whole = blocked.isNotNull() & blocking.isNotNull() & F.trim(F.coalesce(xml, F.lit(""))).startswith("<")
    report = F.struct(F.col("_x._monitorLoop").try_cast("int").alias("monitor_loop"), wait_resource(blocked["_waitresource"])["database_id"].alias("database_id"), _process(blocked).alias("blocked"), _process(blocking).alias("blocking"))
    return out.withColumn("report", F.when(whole, report)).drop("_x")


def _participants(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        out = []
        for text in part:
            try:
                found = ElementTree.fromstring(text) if text else None
            except ElementTree.ParseError:
                found = None
            spids = [] if found is None else [p.get("spid", "").strip() for p in found.iter("process")]
            numbers = list(dict.fromkeys(int(s) for s in spids if s.lstrip("+-").isdigit()))
            out.append(numbers or None)
        yield pd.Series(out, dtype=object)


def parse_deadlock(df: DataFrame, xml: str) -> DataFrame:
    """df with participant_spids (array, in document order; null where there are none or the text is no XML) and empty victim_spids."""
    find = F.pandas_udf(_participants, "array<int>")
    return df.withColumn("participant_spids", find(F.col(xml).cast("string"))).withColumn("victim_spids", F.array().cast("array<int>"))
