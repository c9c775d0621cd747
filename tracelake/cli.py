"""Commands: import, top-slow, export-blocking, export-events, query-store-import, anonymize-plans, obfuscate-plan."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.fields import duration_text
from .operators import digest, export, workload
from .operators.querystore import parse_window
from .sources import history
from .sources.plans import anonymize_file, anonymize_folder, anonymize_saved
from .sources.project import Project


def text_table(rows: list, unit: str = "ms") -> str:
    return "\n".join(f"{r['statement_kind']:<8}{r['cnt']:>10}{duration_text(r['total_us'], unit):>16}  {r['normalized_sql'][:80]}" for r in rows)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracelake")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("import")
    one.add_argument("path")
    one.add_argument("--redaction", choices=["off", "masked", "hash", "full"])
    two = commands.add_parser("top-slow")
    two.add_argument("--limit", type=int, default=20)
    three = commands.add_parser("export-blocking")
    three.add_argument("--format", default="both", choices=["json", "md", "both"])
    three.add_argument("--samples", type=int, default=5)
    three.add_argument("--full", action="store_true")
    four = commands.add_parser("export-events")
    four.add_argument("--kind", default="blocking", choices=["blocking", "deadlock"])
    for name in ("--from", "--to", "--last", "--fingerprint"):
        four.add_argument(name)
    four.add_argument("--database", type=int)
    four.add_argument("--limit", type=int, default=100)
    five = commands.add_parser("anonymize-plans")
    five.add_argument("source")
    five.add_argument("target")
    five.add_argument("--map")
    six = commands.add_parser("obfuscate-plan")
    six.add_argument("--plan-id")
    six.add_argument("--in", dest="source")
    six.add_argument("--out", dest="target")
    six.add_argument("--project")
    seven = commands.add_parser("query-store-import")
    for name in ("--conn", "--views", "--database", "--from", "--to", "--last", "--version"):
        seven.add_argument(name)
    seven.add_argument("--no-plans", action="store_true")
    for p in (one, two, three, four, seven):
        p.add_argument("--project", required=True)
    for p in (three, four):
        p.add_argument("--out", required=True)
    a = parser.parse_args(args)
    if a.command == "anonymize-plans":
        errors = anonymize_folder(a.source, a.target, a.map)
        print("\n".join(f"{path}: {error}" for path, error in errors.items()) or "done")
        return int(bool(errors))
    if a.command == "obfuscate-plan" and a.source:
        path, n = anonymize_file(a.source, a.target or f"{os.path.splitext(a.source)[0]}.anon.sqlplan")
        print(f"{n} names: {path}")
        return 0
    project = Project(SparkSession.builder.getOrCreate(), a.project)
    if a.command == "obfuscate-plan":
        path, n = anonymize_saved(project, a.plan_id)
        print(f"{n} names: {path}")
    elif a.command == "query-store-import":
        return _import_history(project, a)
    elif a.command == "import":
        print(project.import_events(a.path, a.redaction))
    elif a.command == "top-slow":
        print(text_table(workload.top_statements(project.signed(), a.limit).collect(), project.config()["display.durationUnit"]))
    elif a.command == "export-blocking":
        reports, processes = project.table("blocking_reports"), project.table("blocking_processes")
        os.makedirs(export.safe_folder(a.out), exist_ok=True)
        if a.full:
            digest.full_dump(reports, processes).write.mode("overwrite").text(os.path.join(a.out, "full"))
        built = digest.build(reports, processes, project.table("deadlock_reports"), project.table("normalized_queries"), a.samples).persist()
        for kind, body in (("json", lambda: digest.as_json(built).first()[0]), ("md", lambda: digest.as_markdown(built))):
            if a.format in (kind, "both"):
                with open(os.path.join(a.out, f"blocking.{kind}"), "w", encoding="utf-8") as out:
                    out.write(body())
    else:
        start, end = parse_window(getattr(a, "from"), a.to, a.last)
        reports = project.table("blocking_reports" if a.kind == "blocking" else "deadlock_reports")
        lit = lambda x: None if x is None else F.lit(x).cast("timestamp_ntz")
        rows = export.candidates(reports, lit(start), lit(end), a.database, a.fingerprint, project.table("blocking_processes"))
        written = export.write_files(export.selection(rows, a.kind, a.limit), a.out, a.kind)
        print(f"{len(written)} written; {export.counts(rows, a.kind).first().asDict()}")
    return 0


def _import_history(project: Project, a: argparse.Namespace) -> int:
    config = project.config()
    url = a.conn or config["server.connectionString"]
    if not (url or a.views):
        print("no source: give --conn or --views, or set server.connectionString in config.json", file=sys.stderr)
        return 1
    if not a.no_plans and config["ingest.redactionPolicy"] != "off":
        print(f"warning: plans are written as they are and may hold literal values (policy: {config['ingest.redactionPolicy']}); --no-plans leaves them out", file=sys.stderr)
    try:
        window = parse_window(getattr(a, "from"), a.to, a.last)
        views = history.from_folder(project.spark, a.views) if a.views else history.from_server(project.spark, url, a.database)
        row = history.import_history(project, views, window, a.database, version=a.version, write_plans=not a.no_plans)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    print("run {run_id}: queries={queries_count} texts={query_text_count} plans={plans_count} runtime={runtime_stat_rows} waits={wait_stat_rows} files={plan_files_written} failures={plan_write_failures}".format(**row))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
