"""Personal data: base spans against Python's re, and what the method adds."""

import random
import re

from conftest import SF
from pyspark.sql import functions as F

from riskloom.llm import pii
from riskloom.llm.spans import joined

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
R = random.Random(1)
TEXTS = [
    None, "", "a@b.c a@b..c x.@y.z. _a@b.c_d@e.f", "a@b.c-d.e.f.@g.h @ a@b",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111  4111-1111-1111-1111 4111  1111",
    "5 4111111111111111-", "+1 (555) 123-4567 +12 +1-- +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "😀 a@b.cd é +33 6 12 34 56 78",
    "a" * 30000 + "@b.c", "." * 5000, "1 " * 8000, "a." * 20000 + "@" + "b." * 9000, "+1" + " " * 9000 + "1",
]
TEXTS += ["".join(R.choice("ab1234567890.@+- ()%é\n") for _ in range(300)) for _ in range(200)]
ADDED = "please call (555) 123-4567 or write: my SSN: 123-45-6789."


def right(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and right(digits)
                or kind == "phone" and 9 <= len(digits) <= 15
            )
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out))


def test_base_spans(spark):
    docs = spark.createDataFrame([(k, t, "b") for k, t in enumerate(TEXTS)], "doc_id long, text string, base string")
    got = pii.find_pii(docs).select("doc_id", joined(F.col("base")).alias("b"), joined(F.col("spans")).alias("s")).collect()
    assert {r.doc_id: r.b for r in got} == {k: plain(t) for k, t in enumerate(TEXTS)}
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in got)


def test_the_method_adds_spans(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, ADDED), (-1, ADDED), (None, "ordinary words only")], "doc_id long, text string")
    docs = real.union(more)
    got = pii.find_pii(docs)
    found = [r.s for r in got.where("doc_id = -1").select(joined(F.col("spans")).alias("s")).collect()]
    assert found == [f"phone:{ADDED.index('(')}:{ADDED.index(' or')},ssn:{ADDED.index('123-45-')}:{len(ADDED) - 1}"] * 2
    clean = pii.redact(docs.where("doc_id = -1").limit(1), got.where("doc_id = -1").limit(1)).first().text
    assert clean == "please call [phone] or write: my SSN: [ssn]."
    assert got.count() == docs.count()


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_voters_are_weighed():
    model = pii.weigh([((1, 0, 1, 1), 50), ((1, 0, 0, 1), 50), ((-1, 0, 0, -1), 300), ((-1, 0, 1, -1), 5)])
    assert model.posterior((1, 0, 1, 1)) > 0.95 > 0.05 > model.posterior((-1, 0, 0, -1))
    assert abs(pii.weigh([]).share - 0.5) < 1e-9
