"""Secret scans over an incremental blob ledger, with DataFrame and SQL functions only.

Every text is a blob, named by its SHA-256. The ledger is a Parquet table with one row for each blob and rule version
that was ever scanned, clean blobs included. A scan takes the blobs of all rows, drops by anti join those which the
ledger has under the current rule version, runs the rules on the rest, appends what it found, and joins the ledger back
to every path that carries the blob.

Defined results: a null text is the empty text; repeated rows and equal texts share one blob, are scanned once and each
get its findings; null ids are kept as they are; an empty table gives no rows; columns other than the path and text
columns pass through `scan` untouched and may have any names (internal columns are prefixed `_tl_`).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_broadcast, joined_spans, replaced, spans_of, work_dir, written

#: Name, pattern, and the least length of the match (or of its second group).
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]+", 16),
)
RULE_VERSION = "2024-1"
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _cheap_tests(text: Column) -> dict[str, Column]:
    """Cheap tests first: most texts can hold no match at all, and a rule's pattern then never runs."""
    return {"assign": F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike("[0-9a-f]{16}")}


def _found(text: Column) -> Column:
    """All findings of the rules in one text, by start and then by the rules' order."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,hit:string>>")
    may = _cheap_tests(text)
    found = []
    for rank, (kind, pattern, least) in enumerate(RULES):
        if kind == "hex":  # a run is maximal, so asking for its length in the pattern drops the same matches
            pattern = f"[0-9a-f]{{{least},}}"
        spans = F.when(may[kind], spans_of(text, pattern, kind)).otherwise(none)
        found.append(F.transform(F.filter(spans, _long_enough(pattern, 2 if kind == "assign" else 0, least)), _sortable(rank)))
    return F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(SPANS)


def _long_enough(pattern: str, group: int, least: int):
    return lambda s: F.length(F.regexp_extract(s["hit"], pattern, group) if group else s["hit"]) >= least


def _sortable(rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update_ledger(docs: DataFrame, ledger: str, text: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """Scans the blobs of docs that the ledger at this path lacks under this version, appends them, returns the ledger's rows of this version.

    Columns: blob, version, findings. A blob is appended once for each version; a job that died half-way leaves no
    part of its rows (the writer commits at its end), so a second call scans what is still missing."""
    spark = docs.sparkSession
    blobs = docs.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    schema = f"blob string, version string, findings {SPANS}"
    known = _existing(spark, ledger, schema)
    if known is not None:
        # Names alone tell what was never scanned; only the texts of those are looked at again.
        names = docs.select(blob_id(F.col(text)).alias("blob")).distinct()
        unseen = written(names.join(known.where(F.col("version") == version).select("blob"), "blob", "left_anti"), work_dir(spark, "unseen-blobs"))
        blobs = blobs.join(bounded_broadcast(unseen), "blob", "left_semi")
    # Grouping begins within each task, so copies of a text hardly travel.
    blobs = blobs.groupBy("blob").agg(F.first("body").alias("body"))
    blobs.select("blob", F.lit(version).alias("version"), _found(F.col("body")).alias("findings")).write.mode("append").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).where(F.col("version") == version)


def _hits(rows: DataFrame) -> DataFrame:
    """The ledger's blobs with findings, each once (scans at the same time may both append one), as a table.

    A written one: rows of a frequent text can then be split among tasks where they are joined."""
    return written(rows.where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"]), work_dir(rows.sparkSession, "findings"))


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def _may_hold(text: Column) -> Column:
    """Whether the rules may find anything in the text: true of each text with a finding, false of most others."""
    # A finding ends with a run of one class, which is long enough; so many of its characters make a match already.
    ends = {"assign": "{12})", "access": "{14}", "hex": "{16}"}
    cheap = _cheap_tests(text)
    tests = [cheap[kind] & text.rlike(pattern.removesuffix(")").removesuffix("+") + ends[kind]) for kind, pattern, _ in RULES]
    return F.coalesce(functools.reduce(operator.or_, tests), F.lit(False))


def _joined(docs: DataFrame, ledger: str | None, text: str, version: str) -> DataFrame:
    """docs with a column `_tl_findings`."""
    rows = update_ledger(docs, ledger or work_dir(docs.sparkSession, "blob-ledger"), text, version)
    hits = _hits(rows).select(F.col("blob").alias("_tl_blob"), F.col("findings").alias("_tl_findings"))
    # Rows that can't have findings don't travel; other versions may stand for other rules.
    may = _may_hold(F.col(text)) if version == RULE_VERSION else F.lit(True)
    none = F.array().cast(SPANS)
    keyed = docs.where(may).withColumn("_tl_key", blob_id(F.col(text)))
    joined = keyed.join(hits, F.col("_tl_key") == F.col("_tl_blob"), "left").drop("_tl_key", "_tl_blob").withColumn("_tl_findings", F.coalesce("_tl_findings", none))
    return joined.union(docs.where(~may).withColumn("_tl_findings", none))


def scan(docs: DataFrame, ledger: str | None = None, text: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """docs with a column `findings` (in place of one of that name): array<struct<kind, start, end>>, by start and then kind; never null."""
    found = _joined(docs, ledger, text, version)
    return found.withColumn("findings", F.col("_tl_findings")).drop("_tl_findings")


def digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans and all spans of each row of docs."""
    # Ids and blob names go through the join, not texts.
    spark = docs.sparkSession
    rows = update_ledger(docs, ledger or work_dir(spark, "blob-ledger"))
    found = docs.select("doc_id", blob_id(F.col("text")).alias("blob")).join(_hits(rows), "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(SPANS)).alias("findings"))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k, _, _ in RULES), F.sha2(joined_spans(F.col("findings")), 256).alias("base_sha256"), joined_spans(F.col("findings")).alias("spans"), "blob")


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with each finding in the text replaced by the mark (overlapping findings by one); other rows unchanged.

    A column n_chars, if there is one, is set to the length of the text."""
    found = _joined(docs, ledger, "text", RULE_VERSION)
    out = found.withColumn("text", replaced(F.col("text"), F.col("_tl_findings"), mark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_tl_findings") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
