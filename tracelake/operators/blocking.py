"""Questions about blocked processes: reports (report_id, captured_at, monitor_loop, ...) and their processes, two to a report."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import written
from .quantiles import of_counts

DEPTH = 64
#: Links of a loop up to which one task walks it; larger loops are walked by joins.
LOOP = 100_000


def _of(processes: DataFrame, role: str) -> DataFrame:
    return processes.where(F.col("role") == role)


def overview(reports: DataFrame, deadlocks: DataFrame) -> DataFrame:
    """Counts of both kinds of report and the times between which processes were blocked: one row."""
    blocked = reports.agg(F.count("*").alias("blocking_reports"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))
    return blocked.crossJoin(deadlocks.agg(F.count("*").alias("deadlock_reports")))  # one row each


def locality(processes: DataFrame) -> DataFrame:
    """Blocked processes by type of resource, and their share in percent."""
    counts = _of(processes, "blocked").groupBy("wait_resource_type").agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())  # a row for each type of resource
    return counts.select("wait_resource_type", "cnt", (F.lit(100.0).cast("double") * F.col("cnt") / F.nullif(total, F.lit(0))).alias("pct"))


def counts_by(processes: DataFrame, column: str, drop_null: bool = False, limit: int | None = None) -> DataFrame:
    """Blocked processes by a column, largest count first."""
    rows = _of(processes, "blocked")
    rows = rows.where(F.col(column).isNotNull()) if drop_null else rows
    out = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("key")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "key")
    return out if limit is None else out.limit(limit)


def top_statements(processes: DataFrame, signatures: DataFrame, role: str, limit: int = 10) -> DataFrame:
    """Statements that blocked (or were blocked) most often, by fingerprint, with the text to show."""
    rows = _of(processes, role).where(F.col("inputbuf_fingerprint").isNotNull())
    # Counted before the join: a row for each statement meets the signatures, not one for each process.
    counted = rows.groupBy("inputbuf_fingerprint", "inputbuf").agg(F.count("*").alias("n"))
    joined = counted.join(signatures, counted["inputbuf_fingerprint"] == signatures["normalized_hash"], "left")
    shown = joined.select("inputbuf_fingerprint", F.coalesce("normalized_sql", "inputbuf", F.lit("(none)")).alias("display_sql"), "n")
    return shown.groupBy("inputbuf_fingerprint", "display_sql").agg(F.sum("n").alias("cnt")).orderBy(F.desc("cnt"), "inputbuf_fingerprint", "display_sql").limit(limit)


def wait_times(processes: DataFrame) -> DataFrame:
    """Median, 95th percentile and greatest wait of blocked processes: one row, of zeros without any."""
    counts = _of(processes, "blocked").groupBy(F.col("wait_time_us").alias("value")).agg(F.count("*").alias("n"))
    found = of_counts(counts, [], {"p50_us": 0.5, "p95_us": 0.95})
    zero = F.lit(0)
    # One row each.
    return counts.agg(F.max("value").alias("m")).join(found, how="left").select(F.coalesce("p50_us", zero.cast("double")).alias("p50_us"), F.coalesce("p95_us", zero.cast("double")).alias("p95_us"), F.coalesce("m", zero.cast("bigint")).alias("max_us"))


def edges(reports: DataFrame, processes: DataFrame) -> DataFrame:
    """loop, blocking, blocked: a link for each report that has both processes."""
    pair = lambda role: _of(processes, role).select("report_id", F.col("spid").alias(role))
    return reports.select("report_id", F.col("monitor_loop").alias("loop")).join(pair("blocked"), "report_id").join(pair("blocking"), "report_id").select("loop", "blocking", "blocked")


def _walk(links: list[tuple]) -> list[tuple]:
    """(head, depth) of one loop's (blocking, blocked) links: the greatest depth that each head reaches, its own being 1.

    Each level holds the set of (head, place) pairs, so ways that meet don't multiply; cycles end at DEPTH. As in SQL, null
    is a place that leads nowhere, and a null blocker is a head."""
    next_of: dict = {}
    for a, b in links:
        next_of.setdefault(a, set()).add(b)
    heads = next_of.keys() - {b for _, b in links if b is not None}
    next_of.pop(None, None)
    depth = dict.fromkeys(heads, 1)
    level, n = {(h, h) for h in heads}, 1
    while level and n < DEPTH:
        level = {(h, b) for h, a in level for b in next_of.get(a, ())}
        n += 1
        depth.update((h, n) for h, _ in level)
    return sorted(depth.items(), key=lambda x: (x[0] is not None, x[0]))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of loops whose links come one loop after another; one loop is held at a time."""
    loop, links, kinds = None, [], None
    for batch in itertools.chain(batches, [None]):
        rows = []
        if batch is not None:
            kinds = [batch.schema.field(c).type for c in ("loop", "blocking")]
        incoming = zip(*(batch.column(c).to_pylist() for c in ("loop", "blocking", "blocked")), strict=True) if batch is not None else [(None, None, None)]
        for at, a, b in incoming:
            if at != loop:
                if links:
                    rows += [(loop, head, depth, len(links)) for head, depth in _walk(links)]
                loop, links = at, []
            if batch is not None:
                links.append((a, b))
        if kinds:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int32(), pa.int64()], strict=True)], ["loop", "head", "depth", "edges"])


def _walk_by_joins(links: DataFrame) -> DataFrame:
    """The same for loops of any size: one distinct join for each level, each level a written table."""
    pairs = written(links.select("loop", "blocking", "blocked").distinct(), "links")
    heads = pairs.select("loop", "blocking").distinct().join(pairs.select("loop", F.col("blocked").alias("blocking")), ["loop", "blocking"], "left_anti")
    level = heads.select("loop", F.col("blocking").alias("head"), F.col("blocking").alias("at"))
    level = written(level, "chains")
    found = [level.select("loop", "head").distinct().withColumn("depth", F.lit(1))]
    for n in range(2, DEPTH + 1):
        level = written(level.join(pairs.withColumnRenamed("blocking", "at"), ["loop", "at"]).select("loop", "head", F.col("blocked").alias("at")).distinct(), "chains")
        if level.isEmpty():
            break
        found.append(level.select("loop", "head").distinct().withColumn("depth", F.lit(n)))
    deepest = found[0]
    for more in found[1:]:
        deepest = deepest.union(more)
    return deepest.groupBy("loop", "head").agg(F.max("depth").alias("depth")).join(links.groupBy("loop").agg(F.count("*").alias("edges")), "loop").select("loop", "head", "depth", "edges")


def chains(reports: DataFrame, processes: DataFrame, loop_size: int = LOOP) -> DataFrame:
    """loop, head, depth, edges of every blocking chain, deepest first.

    A head is a blocker that is never blocked in its loop. Links without a loop never meet others: their blockers are
    heads of depth 1 with 0 links."""
    links = edges(reports, processes)
    looped = links.where(F.col("loop").isNotNull())
    kinds = f"loop {links.schema['loop'].dataType.simpleString()}, head {links.schema['blocking'].dataType.simpleString()}, depth int, edges bigint"
    large = looped.groupBy("loop").count().where(F.col("count") > loop_size).select("loop")
    small = looped.join(large, "loop", "left_anti").repartition("loop").sortWithinPartitions("loop")
    out = small.mapInArrow(_walks, kinds)
    if not large.isEmpty():
        out = out.union(_walk_by_joins(looped.join(large, "loop", "left_semi")))
    alone = links.where(F.col("loop").isNull() & F.col("blocking").isNotNull()).select("loop", F.col("blocking").alias("head")).distinct().select("loop", "head", F.lit(1).alias("depth"), F.lit(0).cast("bigint").alias("edges"))
    return out.union(alone).orderBy(F.desc("depth"), F.asc_nulls_last("loop"), "head")


def samples(reports: DataFrame, processes: DataFrame, fingerprints: DataFrame, limit: int = 5) -> DataFrame:
    """The first reports of each given blocker, all at once: one ranking instead of a query for each."""
    rows = _of(processes, "blocking").join(fingerprints.select("inputbuf_fingerprint").distinct(), "inputbuf_fingerprint").select("report_id", "inputbuf_fingerprint").join(reports, "report_id")
    first = Window.partitionBy("inputbuf_fingerprint").orderBy(F.asc_nulls_last("captured_at"), "report_id")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)


def report_rows(reports: DataFrame, processes: DataFrame) -> DataFrame:
    """Each report with both of its processes as structs."""
    fields = F.struct(*(c for c in processes.columns if c not in ("report_id", "role")))
    side = lambda role: _of(processes, role).select("report_id", fields.alias(role))
    return reports.join(side("blocked"), "report_id", "left").join(side("blocking"), "report_id", "left")


