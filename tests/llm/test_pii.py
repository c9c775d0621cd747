import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tracelake.llm import pii


def luhn(hit):
    d = [int(c) for c in re.sub("[^0-9]", "", hit)]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0


RULES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda h: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda h: all(int(x) <= 255 for x in h.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), luhn),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda h: 10 <= len(re.sub("[^0-9]", "", h)) <= 15),
)


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, keep) in enumerate(RULES) for m in pattern.finditer(text or "") if keep(m[0])]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


ODD = [
    None, "", "a@b.cd_x@y.zz", "x@y@z.com", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (942) 555-3625, +1--2", "😀 é@x.y me@é.com a.b@c-d.e-f.gh",
    "4111111111111111", "9" * 4000, "a" * 60_000, "call 555-123-4567 or (555) 123-4567", "+" + "1 " * 3000, "a.b-c@" * 2000, "12345678901234567890 5500005555555559.1.2.3", "write to bob [at] example [dot] com", "iban DE89 3704 0044 0532 0130 00", "ssn 123-45-6789", "+4479111234567",
]


def test_base_spans_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(i - 100, x) for i, x in enumerate(ODD)], "doc_id bigint, text string")
    docs = docs.union(odd).union(odd.limit(7)).withColumn("kind", F.lit(1)).withColumn("row", F.lit("clash"))
    got = pii.digest(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r, want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(re.findall(rf"\b{k}:", want)) for k in ("email", "ip", "card", "phone"))
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))
    added = {texts[r.doc_id]: r.spans for r in got}
    assert "email_obscured:9:" in added["write to bob [at] example [dot] com"]
    assert "account:5:" in added["iban DE89 3704 0044 0532 0130 00"] and "identity:4:15" in added["ssn 123-45-6789"]


def test_reliable_labelers_are_trusted():
    rows = [("email", "++++", 900), ("email", "+--+", 20), ("identity", "-0-+", 50), ("identity", "+0++", 50)]
    post = pii.estimate(rows)
    assert post["email", "++++"] > 0.95 and post["identity", "+0++"] > 0.5 > post["identity", "-0-+"]


def test_many_matches_in_a_text(spark):
    rng = random.Random(6)
    parts = ["a.b@c.de ", "ssn 123-45-6789 ", "+1 (942) 555-3625, ", "10.1.2.3;", "4111 1111 1111 1111 ", "call 555-123-4567 or ", "é "]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (3, 127, 128, 400, 60_000)]
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert time.time() - began < 120
    for i, text in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(brute(text).encode()).hexdigest()
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s]
        assert [s[1] for s in spans] == sorted(s[1] for s in spans)
        base, end = {k for k, *_ in RULES}, 0
        for kind, start, stop in spans:  # no added span meets a base one
            if kind not in base:
                assert start >= end
            else:
                end = max(end, stop)
        assert {k for k, *_ in spans} - base <= set(pii.WIDER)


def test_empty(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
