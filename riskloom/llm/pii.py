"""Personal data: patterns, word lists and contexts vote, expectation-maximisation weighs the voters, a span classifier decides.

Built from DataFrame functions only; what the driver sees are counts of vote patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import landed, let, query, table
from .spans import apart, count_of, joined, matches, ordered, when

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "iban", "name"]
VOTERS = ["pattern", "words", "context", "shape"]
CONTEXT = 32
CERTAIN = 0.5

# The patterns of the base kinds. Group loops are avoided (the JVM recurses in them): what may not
# match is replaced by another character of length one first, see base_spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further candidates of the method.
HIDDEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z]{2,24}+"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])"
GIVEN_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph "
    "Jessica Thomas Sarah Charles Karen Hans Claudia Jürgen Ursula Pierre Marie Jean Nathalie Carlos Carmen José Lucía"
).split()
NAME = r"(?<![\p{L}])(?:" + "|".join(GIVEN_NAMES) + r")\x20\p{Lu}\p{Ll}{1,30}+"
DOMAINS = "com org net edu gov io info de fr es uk it nl".split()
NEAR = r"(?:e-?mail|contact|write to|call|phone|tel|mobile|fax|card|visa|payment|credit|address|ssn|social|iban|account|name|mr|mrs|dear)\W*$"
AGAINST = r"(?:version|release|build|isbn|order|invoice|ticket|section|id|no\.?|figure|table|rfc)\W*$"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def total(d: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.length(d) - 1, F.lit(0)))
        value = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = lambda i: F.when(i % 2 == 1, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
        return F.aggregate(at, F.lit(0), lambda acc, i: acc + twice(i))

    return let(digits, lambda d: F.coalesce(total(d) % 10 == 0, F.lit(False)))


def sound(span: Column) -> Column:
    """Whether a match of a base pattern passes its test."""

    def parts(m: Column) -> Column:
        return F.forall(
            F.split(m, "[.]"),
            lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)),
        )

    size = F.length(_digits(span["match"]))
    return (
        F.when(span["kind"] == "email", F.lit(True))
        .when(span["kind"] == "ip", parts(span["match"]))
        .when(span["kind"] == "card", size.between(12, 19) & luhn(_digits(span["match"])))
        .otherwise(size.between(9, 15))
    )


def base_matches(text: Column) -> Column:
    """All matches of the base patterns, tested or not, whole text."""
    # Domains: a dot that no label follows can't go on; local parts take "%" as well as ".".
    dots = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "%")
    # Cards: a separator counts only between two digits.
    single = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x")
    return F.concat(
        when(F.contains(text, F.lit("@")), matches(dots, EMAIL, "email", text)),
        when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), matches(text, IP, "ip")),
        when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), matches(single, CARD, "card", text)),
        when(F.contains(text, F.lit("+")), matches(text, PHONE, "phone")),
    )


def further_matches(text: Column) -> Column:
    return F.concat(
        when(F.rlike(text, F.lit(r"[\[(]at[\])]")), matches(text, HIDDEN_EMAIL, "email")),
        when(F.rlike(text, F.lit(r"[0-9]{3}[\x20.-][0-9]{4}")), matches(text, LOCAL_PHONE, "phone")),
        when(F.rlike(text, F.lit("[0-9]{3}-[0-9]{2}-[0-9]{4}")), matches(text, SSN, "ssn")),
        when(F.rlike(text, F.lit("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}")), matches(text, IBAN, "iban")),
        when(F.rlike(text, F.lit(NAME)), matches(text, NAME, "name")),
    )


def votes(text: Column, span: Column) -> Column:
    """One vote per voter: 1 personal, 0 none, -1 not. The pattern voter says whether a base match passed its test."""
    kind, match = span["kind"], span["match"]
    before = F.lower(F.substring(text, F.greatest(span["start"] + 1 - CONTEXT, F.lit(1)), F.least(span["start"], F.lit(CONTEXT))))
    digits = _digits(match)
    listed = F.array(*[F.lit(x) for x in DOMAINS])
    last = F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1))
    words = (
        F.when(kind == "email", F.when(F.array_contains(listed, last), 1).otherwise(0))
        .when(kind == "name", 1)
        .when(kind == "ip", F.when(F.rlike(match, F.lit(r"^(?:0+|127|255)\.")), -1).otherwise(0))
        .otherwise(0)
    )
    shape = (
        F.when(kind.isin("card"), F.when(luhn(digits) & F.length(digits).between(12, 19), 1).otherwise(-1))
        .when(kind == "ssn", F.when(F.rlike(match, F.lit("^(?:000|666|9)|-00-|-0000$")), -1).otherwise(1))
        .when(kind == "phone", F.when(F.length(digits).between(9, 15), 1).otherwise(-1))
        .when(kind == "name", 0)
        .otherwise(F.when(F.length(F.regexp_replace(match, r"(.)\1{3,}", "")) < 6, -1).otherwise(1))
    )
    context = F.when(F.rlike(before, F.lit(NEAR)), 1).when(F.rlike(before, F.lit(AGAINST)), -1).otherwise(0)
    pattern = F.when(span["base"], 1).when(span["tested"], -1).otherwise(0)
    return F.array(*[v.cast("int") for v in (pattern, words, context, shape)])


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, marked``: spans that pass, and every match with its votes. One scan of the texts, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    tested = F.transform(
        base_matches(F.col("text")),
        lambda s: F.struct(s["start"], s["end"], s["kind"], s["match"], F.lit(True).alias("tested"), sound(s).alias("base")),
    )
    further = F.transform(
        further_matches(F.col("text")),
        lambda s: F.struct(s["start"], s["end"], s["kind"], s["match"], F.lit(False).alias("tested"), F.lit(False).alias("base")),
    )
    rows = rows.select("doc_id", "text", F.concat(tested, further).alias("all"))
    marked = F.transform(
        "all",
        lambda s: F.struct(s["start"], s["end"], s["kind"], s["base"], votes(F.col("text"), s).alias("votes")),
    )
    return landed(rows.select("doc_id", marked.alias("marked")), "pii-candidates")


@dataclass
class Voters:
    """Share of personal spans, and for either class the chances of the votes -1, 0, 1 of each voter."""

    share: float
    chances: list[list[list[float]]]  # [class][voter][vote + 1]

    def posterior(self, votes: tuple[int, ...]) -> float:
        like = [1 - self.share, self.share]
        for z in (0, 1):
            for v, vote in enumerate(votes):
                like[z] *= self.chances[z][v][vote + 1]
        return like[1] / (like[0] + like[1])


def weigh(counts: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> Voters:
    """Reliabilities of the voters from counts of vote patterns (at most 81), by expectation-maximisation.

    Starts from voters that are right more often than not, which names the classes.
    """
    right = [[0.45, 0.45, 0.10], [0.10, 0.35, 0.55]]
    model = Voters(0.5, [[list(right[z]) for _ in VOTERS] for z in (0, 1)])
    total = sum(n for _, n in counts)
    for _ in range(rounds if total else 0):
        mass = [[[1.0] * 3 for _ in VOTERS] for _ in (0, 1)]  # one vote of each sort is added: no chance is zero
        good = 1.0
        for some, n in counts:
            p = model.posterior(some)
            good += n * p
            for v, vote in enumerate(some):
                mass[1][v][vote + 1] += n * p
                mass[0][v][vote + 1] += n * (1 - p)
        new = Voters(good / (total + 2), [[[x / sum(voter) for x in voter] for voter in mass[z]] for z in (0, 1)])
        still = abs(new.share - model.share) < 1e-9
        model = new
        if still:
            break
    return model


def _features(span: Column) -> Column:
    """Kind and votes as zeros and ones."""
    kinds = [(span["kind"] == k).cast("double") for k in KINDS]
    votes = [(F.get(span["votes"], v) == vote).cast("double") for v in range(len(VOTERS)) for vote in (-1, 1)]
    return F.array(*kinds, *votes)


def train(rows: DataFrame) -> tuple[list[float], float]:
    """Weights and bias of the span classifier, learnt from the voters' posteriors over all candidates."""
    patterns = rows.select(F.explode("marked").alias("m")).groupBy("m.kind", "m.votes").count()
    patterns = landed(patterns, "vote-patterns")  # at most 7 x 81 rows
    sums: dict[tuple[int, ...], int] = {}
    for r in patterns.collect():
        sums[tuple(r.votes)] = sums.get(tuple(r.votes), 0) + r["count"]
    voters = weigh(sorted(sums.items()))
    size = len(KINDS) + 2 * len(VOTERS)
    if not sums:
        return [0.0] * size, 0.0
    certain = F.lit(0.0)
    for some in sums:
        certain = F.when(F.col("votes") == F.array(*[F.lit(v) for v in some]), voters.posterior(some)).otherwise(certain)
    both = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), w.alias("w")) for y, w in ((1.0, F.col("p")), (0.0, 1 - F.col("p")))]))
    soft = (
        patterns.select("kind", "votes", "count", certain.alias("p"))
        .select(F.struct("kind", "votes").alias("m"), "count", both.alias("y"))
        .select(array_to_vector(_features(F.col("m"))).alias("x"), "y.label", (F.col("y.w") * F.col("count")).alias("weight"))
        .where("weight > 0")
    )
    fit = LogisticRegression(featuresCol="x", weightCol="weight", regParam=1e-4, maxIter=100, standardization=False).fit(soft)
    return [float(w) for w in fit.coefficients], float(fit.intercept)


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` (arrays of start, kind, end), one row per row of ``docs``.

    ``base`` are the tested matches of the fixed patterns; ``spans`` are those and what the classifier
    adds, added spans never overlapping base ones. Null texts are empty; null ids are kept; repeated
    rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    rows = candidates(docs)
    weights, bias = train(rows)
    base = F.filter("marked", lambda s: s["base"])

    def certain(s: Column) -> Column:
        terms = F.zip_with(_features(s), F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w)
        return 1 / (1 + F.exp(-(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + bias))) >= CERTAIN

    added = F.filter("marked", lambda s: ~s["base"] & certain(s))
    spans = F.array_distinct(F.concat(base, apart(added, base)))
    return rows.select("doc_id", ordered(base, KINDS).alias("base"), ordered(spans, KINDS).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """``doc_id, text`` with every span of ``found`` replaced; ids must be unique and not null."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found.select("doc_id", "spans"), "doc_id")
    shown = F.lit(mark.split("{kind}")[0]), F.lit(mark.split("{kind}")[-1])
    done = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["text"],
                    F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]),
                    shown[0], s["kind"], shown[1],
                ).alias("text"),
            ),
        ).otherwise(acc),
    )
    rows = rows.select("doc_id", "text", done.alias("done"))
    rest = F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))
    return rows.select("doc_id", F.concat("done.text", rest).alias("text"))


@query("op5_pii")
def op5(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
