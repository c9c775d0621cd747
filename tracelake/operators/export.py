"""Selection of stored events for export, and the files."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import half_open

REDACTED = "<redacted/>"


def exportable(kind: str) -> Column:
    """Whether the stored XML is the original: blocking reports keep none when redacted, deadlocks a placeholder."""
    return F.col("raw_xml").isNotNull() if kind == "blocking" else F.col("graph_xml").isNotNull() & (F.col("graph_xml") != REDACTED)


def candidates(reports: DataFrame, start=None, end=None, database_id: int | None = None, fingerprint: str | None = None, processes: DataFrame | None = None) -> DataFrame:
    rows = reports.where(half_open(F.col("captured_at"), start, end))
    if database_id is not None:
        rows = rows.where(F.col("database_id") == database_id)
    if fingerprint is not None:
        rows = rows.join(processes.where(F.col("inputbuf_fingerprint") == fingerprint).select("report_id"), "report_id", "left_semi")
    return rows


def selection(rows: DataFrame, kind: str = "blocking", limit: int = 100) -> DataFrame:
    """What is exported, in time order; equal times by id."""
    return rows.where(exportable(kind)).orderBy(F.asc_nulls_last("captured_at"), "report_id").limit(limit)


def counts(rows: DataFrame, kind: str = "blocking") -> DataFrame:
    """How many rows can be exported and how many must be skipped: one scan."""
    return rows.agg(F.count_if(exportable(kind)).alias("matched"), F.count_if(~exportable(kind)).alias("skipped"))


def safe_folder(path: str) -> str:
    if ".." in re.split(r"[\\/]", path):
        raise ValueError(f"no folder above: {path}")
    return path


def write_files(selected: DataFrame, folder: str, kind: str = "blocking") -> list[dict]:
    """A file for each event and index.json beside them; rows come to the driver one partition at a time."""
    os.makedirs(safe_folder(folder), exist_ok=True)
    suffix, xml = ("xml", "raw_xml") if kind == "blocking" else ("xdl", "graph_xml")
    entries = []
    for r in selected.toLocalIterator():
        stamp = r["captured_at"].strftime("%Y%m%dT%H%M%S") if isinstance(r["captured_at"], datetime) else "unknown"
        name = f"{kind}_{stamp}_{r['report_id']}.{suffix}"
        with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
            out.write(r[xml])
        entry = {"kind": kind, "file": name, "report_id": r["report_id"], "captured_at": r["captured_at"].isoformat() if r["captured_at"] else None, "monitor_loop": r["monitor_loop"] if "monitor_loop" in r else None, "database_id": r["database_id"] if "database_id" in r else None}
        entries.append({k: v for k, v in entry.items() if v is not None})
    with open(os.path.join(folder, "index.json"), "w", encoding="utf-8") as out:
        json.dump(entries, out, indent=2)
    return entries
