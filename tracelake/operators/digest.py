"""The blocking digest: all rollups of a project in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocking

VERSION = 1


def build(reports: DataFrame, processes: DataFrame, deadlocks: DataFrame, signatures: DataFrame, samples: int = 5, top: int = 10) -> DataFrame:
    """One row with a column for each section: arrays of structs, in the sections' own order."""
    blockers = blocking.top_statements(processes, signatures, "blocking", top)
    sections = {
        "locality": blocking.locality(processes).orderBy(F.desc("cnt"), "wait_resource_type"),
        "top_objects": blocking.counts_by(processes, "object_id", True, top),
        "lock_modes": blocking.counts_by(processes, "lock_mode"),
        "isolation_levels": blocking.counts_by(processes, "isolation_level"),
        "top_blockers": blockers,
        "top_blocked": blocking.top_statements(processes, signatures, "blocked", top),
        "samples": blocking.samples(reports, processes, blockers, samples).select("inputbuf_fingerprint", "place", "report_id", "captured_at"),
    }
    # These sections are bounded (one row, top-k lists, rollups by small domains): they meet in one row on the driver.
    values, columns = [], []
    for one in (blocking.overview(reports, deadlocks), blocking.wait_times(processes)):
        values += list(one.first())
        columns += [f"{f.name} {f.dataType.simpleString()}" for f in one.schema]
    for name, section in sections.items():
        values.append([r.asDict() for r in section.collect()])
        columns.append(f"{name} array<{section.schema.simpleString()}>")
    bounded = reports.sparkSession.createDataFrame([tuple(values)], ", ".join(columns))
    # Chains grow with the reports: executors gather them, and the other sections come to them.
    return _gathered(blocking.chains(reports, processes)).crossJoin(F.broadcast(bounded)).select(*bounded.columns[:-1], "chains", "samples")  # one row each


def _gathered(chains: DataFrame) -> DataFrame:
    """One row with all chains as an array, deepest first."""
    order = F.struct((-F.col("depth")).alias("a"), F.col("loop").isNull().alias("b"), "loop", "head", F.struct("*").alias("chain"))
    return chains.agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["chain"]).alias("chains"))


#: Sections of the JSON document, and the names of their parts. Readers of the document rely on them.
SECTIONS = {
    "Overview": {"ReportCount": "blocking_reports", "DeadlockCount": "deadlock_reports", "FirstAt": "first_at", "LastAt": "last_at"},
    "Locality": ("locality", {"WaitResourceType": "wait_resource_type", "Count": "cnt", "Pct": "pct"}),
    "TopObjects": ("top_objects", {"Key": "key", "Count": "cnt"}),
    "TopBlockers": ("top_blockers", {"Fingerprint": "inputbuf_fingerprint", "NormalizedSql": "display_sql", "Count": "cnt"}),
    "TopBlocked": ("top_blocked", {"Fingerprint": "inputbuf_fingerprint", "NormalizedSql": "display_sql", "Count": "cnt"}),
    "LockModes": ("lock_modes", {"Key": "key", "Count": "cnt"}),
    "IsolationLevels": ("isolation_levels", {"Key": "key", "Count": "cnt"}),
    "WaitTimes": {"P50Us": "p50_us", "P95Us": "p95_us", "MaxUs": "max_us"},
    "Chains": ("chains", {"MonitorLoop": "loop", "Depth": "depth", "HeadSpid": "head", "EdgeCount": "edges"}),
    "Samples": ("samples", {"Fingerprint": "inputbuf_fingerprint", "Place": "place", "ReportId": "report_id", "CapturedAt": "captured_at"}),
}


def as_json(digest: DataFrame) -> DataFrame:
    """The document: an envelope with its version, indented, fields without a value as null."""

    def section(what) -> Column:
        if isinstance(what, dict):
            # Waits are told in whole microseconds.
            whole = lambda c: F.col(c).cast("bigint") if c in ("p50_us", "p95_us") else F.col(c)
            return F.struct(*(whole(c).alias(n) for n, c in what.items()))
        name, parts = what
        return F.transform(name, lambda x: F.struct(*(x[c].alias(n) for n, c in parts.items())))

    body = F.struct(*(section(what).alias(name) for name, what in SECTIONS.items()))
    return digest.select(F.to_json(F.struct(F.lit(VERSION).alias("SchemaVersion"), body.alias("Digest")), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def lines(digest: DataFrame) -> DataFrame:
    """section, line of everything in the digest: a row for each item, its fields joined by bars; null fields are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def section(name: str, what) -> Column:
        if isinstance(what, dict):
            items = F.array(F.concat_ws("|", *(text(F.col(c).cast("bigint") if c in ("p50_us", "p95_us") else F.col(c)) for c in what.values())))
        else:
            items = F.transform(what[0], lambda x: F.concat_ws("|", *(text(F.round(x[c], 6).cast("decimal(12,6)") if c == "pct" else x[c]) for c in what[1].values())))
        return F.struct(F.lit(name).alias("section"), items.alias("lines"))

    every = digest.select(F.explode(F.array(*(section(n, w) for n, w in SECTIONS.items()))).alias("s"))
    return every.select("s.section", F.explode("s.lines").alias("line"))


def as_markdown(digest: DataFrame) -> str:
    row = digest.first().asDict(recursive=True)
    lines = ["# Blocking digest", "", f"{row['blocking_reports']} blocking reports, {row['deadlock_reports']} deadlocks, {row['first_at']} to {row['last_at']}.", f"Waits: median {row['p50_us']:.0f} us, 95th percentile {row['p95_us']:.0f} us, longest {row['max_us']} us.", ""]
    for name, items in row.items():
        if isinstance(items, list) and items:
            columns = list(items[0])
            lines += [f"## {name.replace('_', ' ').capitalize()}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
            lines += ["| " + " | ".join(_cell(item[c]) for c in columns) + " |" for item in items] + [""]
    return "\n".join(lines)


def _cell(value, n: int = 100) -> str:
    text = "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")
    return text if len(text) <= n else text[:n] + "..."


def full_dump(reports: DataFrame, processes: DataFrame) -> DataFrame:
    """Every report of every known blocker as a line of JSON; reports whose blocker has no fingerprint are left out."""
    rows = blocking.report_rows(reports, processes).where(F.col("blocking.inputbuf_fingerprint").isNotNull())
    return rows.select(F.to_json(F.struct("*")).alias("value"))
