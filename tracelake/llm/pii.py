"""Personal data by weak supervision, with DataFrame and SQL functions only.

1. Candidate spans: the base kinds (email, ip, card, phone) and wider shapes that often, but not always, are personal
   data (obfuscated addresses, national phone and identity numbers, account numbers, mistyped cards).
2. Labelers vote on each candidate (for, against, or not at all): a shape check, a gazetteer, the words before it, and
   the characters beside it.
3. Expectation-maximisation over the counts of vote patterns (at most kinds x 3^4 rows, whatever the corpus) estimates
   how reliable each labeler is and how likely each pattern marks personal data.
4. Those probabilities, as soft labels, train the final span classifier: naive Bayes over hashed shape, preceding word
   and neighbours (at most kinds x 1,032 weights). It decides which wider candidates are added; base spans always stay.

Defined results: a null text is the empty text; repeated rows each get the same result; null ids stay; an empty table
gives no rows; other columns are not read. A wider candidate that overlaps a base span is not added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import before_each, joined_spans, let, spans_of, work_dir, written

# Base patterns. Quantifiers are possessive where nothing could be given back, and a start inside a run that has failed
# from its beginning is not tried again: the same matches in linear time, without deep recursion on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email_obscured": r"[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++)++",
    "phone_national": r"(?<![0-9+.)-])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card_mistyped": BASE["card"],
}
KINDS = [*BASE, *WIDER]
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What a text must hold for a pattern to be tried at all.
MAY = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){14}", "phone": r"\+[0-9]", "email_obscured": r"[\[(] ?at ?[\])]", "phone_national": r"[0-9]{3}[ .-][0-9]{4}", "identity": r"[0-9]-[0-9]{2}-[0-9]", "account": r"[A-Z]{2}[0-9]{2}", "card_mistyped": r"(?:[0-9][\x20-]?){14}"}
# Gazetteers: fixed values.
ENDINGS = "com org net edu gov io de fr es uk it nl eu us ca au ch at be jp cn in br ru pl se no dk fi info biz dev app ai co me".split()
COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split()
FOR = r"(?i)(?:e-?mail|mail|contact|write|phone|tel|call|fax|mobile|cell|card|visa|mastercard|amex|payment|host|address|login|ssn|social|security|iban|account|konto|cuenta|compte)[^A-Za-z0-9]{0,8}(?:[a-z]{1,6}[^A-Za-z0-9]{1,4})?$"
AGAINST = r"(?i)(?:version|release|isbn|issn|invoice|order|ticket|serial|part|chapter|section|build|ref)[^A-Za-z0-9]{0,8}$"
BUCKETS = 512
VOTES = ("shape", "gazetteer", "context", "beside")
CANDIDATE = "array<struct<start:bigint,rank:int,kind:string,end:bigint,votes:string,form:int,word:int,edge:int>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes; the doubled ones are every second from the right."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _valid(kind: str, hit: Column) -> Column:
    """The rule that a match of the kind's pattern must meet to be a candidate."""
    if kind == "ip":
        return hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return _card(hit)
    if kind == "card_mistyped":
        return F.length(_digits(hit)).between(14, 19) & ~_card(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, "+").when(F.lit(True) if no is None else no, "-").otherwise("0")


def _votes(kind: str, hit: Column, before: Column, after: Column) -> Column:
    digits = _digits(hit)
    shape = {"card_mistyped": F.lit("-"), "identity": _vote(~hit.rlike("^(?:000|666|9)") & ~hit.rlike("-00-|-0000$")), "email": _vote(~hit.rlike(r"^[.-]|\.\.|[.-]@|@-"))}.get(kind, F.lit("+"))
    ending = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1)).isin(ENDINGS)
    gazetteer = {
        "email": _vote(ending),
        "email_obscured": _vote(ending),
        "ip": _vote(~hit.rlike(r"^(?:0|127|255)\.")),
        "card": _vote(digits.rlike("^(?:3[47]|4|5[1-5]|6|2[2-7])")),
        "card_mistyped": _vote(digits.rlike("^(?:3[47]|4|5[1-5]|6|2[2-7])")),
        "phone": _vote(F.substr(digits, F.lit(1), F.lit(1)).isin(CALLING) | F.substr(digits, F.lit(1), F.lit(2)).isin(CALLING), F.lit(False)),
        "account": _vote(F.substr(hit, F.lit(1), F.lit(2)).isin(COUNTRIES)),
    }.get(kind, F.lit("0"))
    context = _vote(before.rlike(FOR), before.rlike(AGAINST))
    beside = _vote(~before.rlike(r"[A-Za-z0-9_]$") & ~after.rlike(r"^[A-Za-z0-9_]"))
    return F.concat(shape, gazetteer, context, beside)


def _bucket(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")


def _candidates(text: Column, kind: str) -> Column:
    """The candidates of one kind, with their votes and features."""
    pattern = (BASE | WIDER)[kind]
    spans = F.filter(spans_of(text, pattern, kind, 40), lambda s: _valid(kind, s["hit"]))

    def described(s: Column) -> Column:
        before, after = s["before"], s["after"]
        form = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["hit"], "[0-9]", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
        edge = F.when(after == "", 0).when(after.rlike(r"\s"), 1).when(after.rlike(r"[.,;:!?)]"), 2).otherwise(3) + F.when(before == "", 0).when(before.rlike(r"\s$"), 4).otherwise(0)
        word = F.lower(F.regexp_extract(before, r"(\w+)\W*$", 1))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), _votes(kind, s["hit"], before, after).alias("votes"), _bucket(form).alias("form"), _bucket(word).alias("word"), edge.cast("int").alias("edge"))

    return F.when(text.rlike(MAY[kind]), F.transform(spans, described)).otherwise(F.array().cast(CANDIDATE))


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """(kind, votes) -> probability of personal data, by expectation-maximisation over (kind, votes, count).

    One accuracy for each labeler and one share for each kind; both are held by a prior of a few rows, so kinds with few
    candidates stay near it and no estimate reaches 0 or 1. A base kind's prior share is higher: it met a strict rule."""
    accuracy = [0.8] * len(VOTES)
    share = {k: 0.9 if k in BASE else 0.4 for k, _, _ in patterns}
    start = dict(share)
    post: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind]))
            odds += sum((1 if v == "+" else -1) * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True) if v != "0")
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for j in range(len(VOTES)):
            right, total = 0.8 * 20, 20.0
            for kind, votes, n in patterns:
                if votes[j] != "0":
                    p = post[kind, votes]
                    right, total = right + n * (p if votes[j] == "+" else 1 - p), total + n
            accuracy[j] = min(0.99, max(0.51, right / total))
        for kind in share:
            own = [(post[k, v] * n, n) for k, v, n in patterns if k == kind]
            share[kind] = (start[kind] * 20 + sum(x for x, _ in own)) / (20 + sum(n for _, n in own))
    return post


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id and spans (array<struct<kind, start, end, base>>, by start, then kind)."""
    spark = docs.sparkSession
    at = work_dir(spark, "pii")
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = body.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*(_candidates(F.col("text"), k) for k in KINDS)).cast(CANDIDATE).alias("found"))
    rows = written(found.withColumn("found", F.array_sort("found")), f"{at}/candidates")
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.*")

    # At most kinds x 3^4 patterns come to the driver, whatever the corpus.
    patterns = sorted((r["kind"], r["votes"], r["count"]) for r in each.groupBy("kind", "votes").count().collect())
    post = [(k, v, p) for (k, v), p in estimate(patterns).items()]
    soft = each.join(F.broadcast(spark.createDataFrame(post, "kind string, votes string, p double")), ["kind", "votes"])

    # Naive Bayes: log odds of each hashed feature value under the soft labels, add-one smoothed.
    names = ("form", "word", "edge")
    values = soft.select("kind", "p", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names))).alias("f")).groupBy("kind", "f.name", "f.value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    kinds = soft.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))
    weights = written(values.join(F.broadcast(kinds), "kind").select("kind", "name", "value", (F.log((F.col("yes") + 1) / (F.col("all_yes") + 2)) - F.log((F.col("no") + 1) / (F.col("all_no") + 2))).alias("weight")), f"{at}/weights")
    scored = soft.where(~F.col("kind").isin(list(BASE))).join(F.broadcast(kinds.select("kind", F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("odds"))), "kind")
    for name in names:  # at most kinds x 1,032 weights
        own = weights.where(F.col("name") == name).select("kind", F.col("value").alias(name), F.col("weight").alias(f"w_{name}"))
        scored = scored.join(F.broadcast(own), ["kind", name], "left")
    # The labelers' own verdict counts beside the classifier's: a span is added when both together favour it.
    score = sum((F.coalesce(f"w_{n}", F.lit(0.0)) for n in names), F.col("odds")) / 2 + F.log(F.col("p") / (1 - F.col("p"))) / 2
    added = scored.where(score > 0).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "kind", "end")).alias("added"))

    plain = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    short = F.transform(F.filter("found", lambda c: c["rank"] < len(BASE)), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end")))
    joined = rows.select("row", "doc_id", short.cast(plain).alias("own")).join(added, "row", "left")
    every = F.when(F.col("added").isNull(), F.col("own")).otherwise(let(F.array_sort(F.concat("own", F.coalesce("added", F.array().cast(plain)))), _apart))
    return joined.select("doc_id", F.transform(every, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (c["rank"] < len(BASE)).alias("base"))).alias("spans"))


def _apart(spans: Column) -> Column:
    """Of these spans (by start, then rank) the base ones, and those others that overlap none of them.

    The farthest end of the base spans before a span and the nearest start of those after it tell, without comparing all pairs."""
    far = F.lit(1 << 60)
    is_base = lambda s: s["rank"] < len(BASE)
    ends = F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0)).cast("bigint"))
    starts = F.transform(F.reverse(spans), lambda s: F.when(is_base(s), far - s["start"]).otherwise(F.lit(0)).cast("bigint"))
    most = lambda a, b: F.greatest(a, b)

    def kept(reach: Column, ahead: Column) -> Column:
        return F.filter(spans, lambda s, i: is_base(s) | ((reach[i] <= s["start"]) & (far - ahead[F.size(spans) - 1 - i] >= s["end"])))

    return let(ends, lambda e: let(starts, lambda f: let(before_each(e, most), lambda reach: let(before_each(f, most), lambda ahead: kept(reach, ahead)))))


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs).select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("own"))
    counts = [F.size(F.filter("own", _is(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("own")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
