"""A project: a folder of Parquet tables, one folder a table, and project.json, on any file system that Spark reaches."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.anonymize import Names
from ..operators.workload import merged_signatures
from . import ingest
from .store import Store, written

TABLES = ("executions", "normalized_queries", "execution_parameters", "blocking_reports", "blocking_processes", "deadlock_reports", "ingestion_runs")
#: Tables that are written anew as a whole: each time as a folder of its own, of which the last whole one counts.
REWRITTEN = ("normalized_queries", "obfuscation_map")
#: Settings and what holds without them.
DEFAULTS = {"display.durationUnit": "ms", "display.cpuUnit": "ms", "ingest.redactionPolicy": "masked", "server.connectionString": None, "server.plansFolder": "./plans"}


class Project:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark)
        self.store.make_folder(path)
        self.manifest = f"{self.path}/project.json"
        if not self.store.exists(self.manifest):
            self.store.write(self.manifest, json.dumps({"version": 1, "created_at": datetime.now(timezone.utc).isoformat()}, indent=2))

    def settings(self) -> dict:
        """The manifest's settings; ${NAME} stands for the environment's value, .env fills in what the environment lacks."""
        values = self._environment()
        return {k: _filled(v, values) for k, v in json.loads(self.store.read(self.manifest)).items()}

    def config(self) -> dict[str, str | None]:
        """The settings of config.json by dotted names, with defaults; an unknown ${NAME} in the connection is empty."""
        at = f"{self.path}/config.json"
        found = json.loads(self.store.read(at)) if self.store.exists(at) else {}
        out = {}
        for name, default in DEFAULTS.items():
            part, _, key = name.partition(".")
            own = found.get(part)
            out[name] = own.get(key) or default if isinstance(own, dict) else default
        if out["server.connectionString"]:
            values = self._environment()
            out["server.connectionString"] = re.sub(r"\$\{(\w+)\}", lambda m: values.get(m[1], ""), out["server.connectionString"])
        return out

    def _environment(self) -> dict[str, str]:
        at, extra = f"{self.path}/.env", {}
        if self.store.exists(at):
            lines = self.store.read(at).splitlines()
            extra = dict(line.strip().split("=", 1) for line in lines if "=" in line and not line.lstrip().startswith("#"))
        return extra | dict(os.environ)

    def _versions(self, table: str) -> list[tuple[int, str]]:
        """The whole copies of a rewritten table, oldest first."""
        found = []
        for path, name, is_file, _ in self.store.children(f"{self.path}/tables"):
            own = re.fullmatch(rf"{table}\.v([0-9]+)", name)
            if own and not is_file and self.store.exists(f"{path}/_SUCCESS"):
                found.append((int(own[1]), path))
        return sorted(found)

    def _at(self, table: str) -> str | None:
        if table in REWRITTEN:
            versions = self._versions(table)
            return versions[-1][1] if versions else None
        path = f"{self.path}/tables/{table}"
        return path if self.store.exists(f"{path}/_SUCCESS") else None

    def table(self, name: str) -> DataFrame | None:
        at = self._at(name)
        return self.spark.read.parquet(at) if at else None

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/tables/{name}")

    def rewrite(self, name: str, rows: DataFrame) -> None:
        """Puts a new copy beside the old ones, which then go. A writer that dies leaves a copy without its mark, which nobody reads."""
        versions = self._versions(name)
        last = max([v for v, _ in versions], default=0)
        rows.write.mode("overwrite").parquet(f"{self.path}/tables/{name}.v{last + 1}")
        for _, path in versions:
            self.store.delete(path)

    def next_id(self, table: str, column: str) -> int:
        own = self.table(table)
        return 1 if own is None else own.agg(F.coalesce(F.max(column), F.lit(0))).first()[0] + 1

    def import_events(self, source: str, redaction: str | None = None, rules: list = ()) -> dict:
        """Imports the captures under a path as one run; the row of the run is written last, so a broken run has none."""
        began = datetime.now(timezone.utc).replace(tzinfo=None)
        redaction = redaction or self.config()["ingest.redactionPolicy"]
        run, files = self.next_id("ingestion_runs", "run_id"), ingest.captures(self.spark, source)
        raw = ingest.landed(self.spark, source)
        found = ingest.tables(raw, run, redaction, rules, (self.next_id("executions", "execution_id"), self.next_id("blocking_reports", "report_id"), self.next_id("deadlock_reports", "report_id")))
        for name in TABLES[:-1]:
            rows = found[name]
            if name in REWRITTEN:
                known = self.table(name)
                self.rewrite(name, rows if known is None else merged_signatures(known, rows.select(known.columns)))
            else:
                self.append(name, rows)
        when = lambda t: F.lit(t).cast("timestamp_ntz")
        row = written(found["ingestion_runs"], "run").select(
            "run_id", F.lit(source).alias("source_path"), F.lit(len(files)).alias("files_count"), F.lit(sum(map(self.store.size, files))).cast("bigint").alias("bytes_total"), when(began).alias("started_at"), when(datetime.now(timezone.utc).replace(tzinfo=None)).alias("finished_at"),
            *(c for c in found["ingestion_runs"].columns if c != "run_id"),
        )
        self.append("ingestion_runs", row)
        return self.table("ingestion_runs").where(F.col("run_id") == run).first().asDict()

    def signed(self) -> DataFrame:
        """Executions with the text, kind and table of their signatures (an inner join: those without one vanish)."""
        return self.table("executions").join(self.table("normalized_queries").select("normalized_hash", "normalized_sql", "statement_kind", "primary_table"), "normalized_hash")

    def names(self) -> Names:
        """The project's map of names and tokens."""
        known = self.table("obfuscation_map")
        return Names.of(tuple(r) for r in known.select("kind", "original_name", "token").collect()) if known is not None else Names()

    def keep_names(self, names: Names) -> None:
        """Adds names that the project's map lacks; a name that it has keeps its token."""
        new = self.spark.createDataFrame(names.rows(), "kind string, original_name string, token string").withColumn("_key", F.lower("original_name"))
        known = self.table("obfuscation_map")
        if known is not None:
            known = known.withColumn("_key", F.lower("original_name"))
            new = known.unionByName(new.join(known.select("kind", "_key"), ["kind", "_key"], "left_anti"))
        self.rewrite("obfuscation_map", new.select("kind", "original_name", "token"))


def _filled(value, values: dict):
    if not isinstance(value, str):
        return value
    for name, own in values.items():
        value = value.replace(f"${{{name}}}", own)
    return value
