"""Shared folder, written tables and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a key set of a few bytes a row may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one under a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_root()}"


@functools.cache
def _local_root() -> str:
    """One folder for this process, gone when it ends."""
    path = tempfile.mkdtemp(prefix="tracelake-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


#: Folders that work_dir has named and remove() has not removed.
_made: list[str] = []


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    _made.append(f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def made_folders() -> list[str]:
    """The folders that work_dir has named so far and that are not removed."""
    return list(_made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that work_dir has named: what was made from them must be written by then."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = [p for p in _made if p not in set(paths)]


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of df, written once as Parquet: later readers need neither its lineage nor the executors that made it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, label: str) -> DataFrame:
    """docs, written, with a key for each row (_tl_row): ids may be null or repeated."""
    return written(docs.withColumn("_tl_row", F.monotonically_increasing_id()), work_dir(docs.sparkSession, label))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower case for A-Z alone. lower() is the same where no character takes two bytes or more."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, small))


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if counting shows at most so many rows; else left to a shuffled join.

    df should be a written table: it is counted here and read again by the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


Batches = Iterator[pa.RecordBatch]


def gives_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, a function for mapInArrow, which hands freed memory back to the system when a task ends.

    Allocators keep what was freed, and an executor's idle workers count with it, whatever runs there next."""

    @functools.wraps(run)
    def ended(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _malloc_trim():
                trim(0)

    return ended


@functools.cache
def _malloc_trim() -> Callable[[int], int] | None:
    """malloc_trim, where the C library has it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


#: Elements that one accumulation copies its result for; longer arrays are accumulated chunk by chunk.
CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once although use may name it often (also within lambdas)."""
    return F.transform(F.array(value), use)[0]


def chunk_starts(values: Column) -> Column:
    """Where each chunk of an array begins (from 1); one chunk of nothing for an empty array."""
    return F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))


def before_each(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array<bigint>, what combine makes of all elements before it, 0 at first.

    Appending to an array copies it, so chunks are accumulated on their own, from what all chunks before them make."""
    none = F.array().cast("array<bigint>")

    def appended(own: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(own, first, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    zero = F.lit(0).cast("bigint")
    wholes = F.transform(chunk_starts(values), lambda s: F.aggregate(F.slice(values, s, CHUNK), zero, combine))
    return let(appended(wholes, zero), lambda offsets: F.flatten(F.transform(chunk_starts(values), lambda s, k: appended(F.slice(values, s, CHUNK), offsets[k]))))


def spans_of(text: Column, pattern: str, kind: str, around: int = 0) -> Column:
    """array<struct<kind, start, end, hit>> of the leftmost non-overlapping matches, code points, end exclusive.

    The texts between matches and the matches themselves, laid end to end, give the positions: no UDF is needed, and no
    text is cut at a position, which would mean to count characters from its start again. With `around`, each span also
    has `before` (so many characters at most, back to where the match before it begins) and `after` (one)."""

    def described(gaps: Column, hits: Column, sizes: Column, ats: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            fields = [F.lit(kind).alias("kind"), (ats[i] + F.length(gaps[i])).alias("start"), (ats[i] + sizes[i]).alias("end"), hit.alias("hit")]
            if around:
                last = F.concat(F.when(i > 0, F.get(hits, i - 1)).otherwise(""), gaps[i])
                fields += [F.right(last, F.lit(around)).alias("before"), F.left(F.concat(gaps[i + 1], F.coalesce(F.get(hits, i + 1), F.lit(""))), F.lit(1)).alias("after")]
            return F.struct(*fields)

        return F.transform(hits, one)

    def placed(gaps: Column, hits: Column) -> Column:
        sizes = F.transform(hits, lambda hit, i: (F.length(gaps[i]) + F.length(hit)).cast("bigint"))
        return let(sizes, lambda sizes: let(before_each(sizes, lambda a, b: a + b), lambda ats: described(gaps, hits, sizes, ats)))

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: placed(gaps, hits)))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with each of these spans (by start) replaced by the mark, spans that overlap by one together.

    A text is cut at positions by counting characters from its start, so it is first cut into a part for each chunk of spans."""

    def cut(whole: Column, start: Column, stop: Column) -> Column:
        return F.substr(whole, (start + 1).cast("int"), (stop - start).cast("int"))

    def joined(spans: Column, reach: Column, end: Column) -> Column:
        def part(s: Column) -> Column:
            base = reach[s - 1]
            stop = F.coalesce(F.get(reach, s - 1 + CHUNK), end)

            def marked(own: Column) -> Column:
                one = lambda span, r: F.when(span["start"] < r, "").otherwise(F.concat(cut(own, r - base, span["start"] - base), F.lit(mark)))
                return F.array_join(F.zip_with(F.slice(spans, s, CHUNK), F.slice(reach, s, CHUNK), one), "")

            return let(cut(text, base, stop), marked)

        return F.concat(F.array_join(F.transform(chunk_starts(spans), part), ""), F.substr(text, (end + 1).cast("int")))

    def reached(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        return let(ends, lambda ends: let(before_each(ends, lambda a, b: F.greatest(a, b)), lambda reach: joined(spans, reach, F.array_max(ends))))

    return F.when(F.size(spans) > 0, let(spans, reached)).otherwise(text)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
