"""Benchmark decontamination by a prefix-filtered set join, with DataFrame and SQL functions only.

Shingles are the windows of each benchmark item: `width` consecutive words, or the whole item where it has fewer words
(but not none). A window occurs in a document only if all of its words do, one after another, so one necessary prefix
token is enough to find it: its rarest word, by counts over all documents. Only document positions that hold such a
word are joined; the window's place around the word gives its start, which must lie inside the document (positional
bound) as its end must (length bound); then the words themselves are compared.

Defined results: a null text has no words; an item without words has no windows; repeated rows each get the same
result; null document ids stay; an item whose id is null hits words but is neither counted nor named; empty tables give no rows, or rows without hits; other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import bounded_broadcast, keyed, lower_az, work_dir, written

WIDTH = 13
#: Up to so many distinct benchmark words the test for them within the scan is a hash set, beyond it a table of `SLOTS` bytes:
#: a word whose slot is marked may be one of them, and the join on the word that follows tells.
INLINE_WORDS, SLOTS = 50_000, 1 << 22
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of the text, with an empty one before a break that it begins with and after one that it ends with."""
    return F.split(lower_az(F.coalesce(text, F.lit(""))), BREAK, -1)


def n_words(words: Column) -> Column:
    return F.size(words) - (words[0] == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, window (array of words): each distinct window of each item."""
    words = items.select("item_id", F.filter(words_of(F.col("text")), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, width))).alias("window")).distinct()


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def _among(words: DataFrame, inline: int) -> Callable[[Column], Column]:
    """A test for the words of a written table (one column): exact where they are few, else one that also passes some others."""
    few = [r[0] for r in words.limit(inline + 1).collect()]
    if len(few) <= inline:
        return lambda word: word.isin(few) if few else F.lit(False)
    marks = bytearray(SLOTS)
    for r in words.select(_slot(words[0]).alias("slot")).distinct().toLocalIterator():  # SLOTS numbers at most
        marks[r.slot] = 1
    table = F.lit(marks)
    return lambda word: F.substr(table, _slot(word) + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items (sorted array of item ids as strings)."""
    spark = docs.sparkSession
    at = work_dir(spark, "decontamination")
    grams = written(windows(items, width), f"{at}/windows")
    vocabulary = written(grams.select(F.explode("window").alias("word")).distinct(), f"{at}/vocabulary")

    # Rarity: how often each benchmark word stands in all documents. Counted within tasks first, then joined.
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    words = words.where(_among(vocabulary, INLINE_WORDS)(F.col("word")))
    counts = written(words.groupBy("word").count().join(bounded_broadcast(vocabulary), "word", "left_semi"), f"{at}/counts")

    # The prefix token of each window and its place there: the rarest word, the first of equals.
    placed = grams.select("item_id", "window", F.posexplode("window").alias("offset", "word")).join(bounded_broadcast(counts), "word", "left")
    best = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.col("offset"), F.col("word"))).alias("least")
    prefixes = written(placed.groupBy("item_id", "window").agg(best).where(F.col("least.count") > 0).select("item_id", "window", F.col("least.offset").alias("offset"), F.col("least.word").alias("word")), f"{at}/prefixes")

    # One pass over the documents: the words around each prefix token, nothing else, leave the row.
    is_rare = _among(written(prefixes.select("word").distinct(), f"{at}/rare"), INLINE_WORDS)
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", n_words(F.col("words")).cast("bigint").alias("n_words"), "words")
    around = F.transform(
        F.filter(F.transform(F.col("words"), lambda w, i: F.when(is_rare(w), i)), lambda i: i.isNotNull()),
        lambda i: F.struct(i.alias("at"), F.element_at("words", i + 1).alias("word"), F.greatest(i - (width - 1), F.lit(0)).alias("first"), F.slice("words", F.greatest(i - (width - 1), F.lit(0)) + 1, 2 * width - 1).alias("near")),
    )
    scanned = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.size("words").alias("size"), around.alias("places")), f"{at}/scanned")
    places = scanned.where(F.size("places") > 0).select("row", "size", F.explode("places").alias("p")).select("row", F.col("size").alias("limit"), "p.at", "p.word", "p.first", "p.near")

    # Join on the prefix token, bound by position and length, then compare the words.
    start = F.col("at") - F.col("offset")
    size = F.size("window")
    verified = (
        places.join(bounded_broadcast(prefixes), "word")
        .where((start >= 0) & (start + size <= F.col("limit")))
        .where(F.slice("near", start - F.col("first") + 1, size) == F.col("window"))
        .select("row", start.alias("start"), (start + size).alias("end"), "item_id")
    )
    verified = written(verified, f"{at}/verified")

    # Words inside any occurrence, each counted once: what each interval adds to those before it.
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = verified.select("row", "start", "end").distinct().withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).cast("bigint").alias("n_hit"))
    named = verified.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return (
        scanned.select("row", "doc_id", "n_words")
        .join(hit.join(named, "row"), "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, whole, each judged by its own text, whatever its id."""
    rows = keyed(docs, "contaminated")
    found = contamination(rows.select(F.col("_tl_row").alias("doc_id"), "text"), items)
    bad = written(found.where(is_contaminated()).select(F.col("doc_id").alias("_tl_bad")), work_dir(docs.sparkSession, "contaminated"))
    return rows.join(bounded_broadcast(bad), F.col("_tl_row") == F.col("_tl_bad"), "left_anti").select(*docs.columns)
