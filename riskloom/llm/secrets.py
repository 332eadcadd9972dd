"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Built from DataFrame functions only; what the driver sees are counts by length class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import landed, let, query, table
from .spans import apart, count_of, joined, matches, ordered, when

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "random"]
WORD = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = WORD + r"""["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = "AKIA[A-Z0-9]++"
HEX = "[0-9a-f]{24,}+"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
# Candidates of the battery.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
LOWER, UPPER_CASE, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "digits": DIGITS,
    "hex": DIGITS + "abcdef",
    "upper hex": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER_CASE,
    "base32": UPPER_CASE + "234567",
    "base36": DIGITS + LOWER,
    "upper base36": DIGITS + UPPER_CASE,
    "base64": UPPER_CASE + LOWER + DIGITS + "+/",
}
# Length classes of the discovery control, by least length.
LENGTHS = [20, 24, 32, 40, 64, 128]
# Share of false discoveries allowed, least chance of the battery for a random string, steps to a unit of -ln p.
FALSE_SHARE, LEAST_CHANCE, STEPS, MOST_STEPS = 0.01, 0.001, 8, 2000
# Class changes per character that ordinary text may have; the likeliest for the token counts.
CHANGE_RATES = [0.05, 0.1, 0.2, 0.4]
# -ln of the chance of a letter in ordinary text, in quarters (rounded down) above "0": a row for the start of a
# word, then one for each letter before. Counted in distinct short words of sf0.1 and of the Python library.
LETTERS = (
    "9=;<8>?>;FC<=<9=C;:9>A@CGE"
    "?=;<>F@B<HD;=6@?G9:7;CCDCJ"
    ":=>C6DHG<@G4DD9BK==C=KIG>H"
    ":G?A:EH4:L<=CE7FH=A:>FJLAM"
    "9?A?5AC>7HH=E>7DH<;;>EAGEL"
    ":A=:<ABA;JG=@7?AC68<ABC@FB"
    ":@A@8:A?7IF<E@7CK9=9=EEHBF"
    "8@BC4F?;;MF<A<<CP;;<=DBPGC"
    "6>BH4KC<;TC>F=:CK><:BC@QGD"
    ">A;?9A?FCIH=>48AF?;9I@IEPA"
    "2E>D8EGE<E>BDG:@ED?D9GDECG"
    "<B>?3B?A9EE<C??@H?9@AD?GBL"
    "9EB?4EGH7JG9EE:CJE>>?EKN7L"
    "7>FA4DIF7KF@>C:9NE=A=HKPBK"
    ":?=88B8><HC?D>;BF?;7ABAMHF"
    "AA>>B:BG?GD>=4>>H8<>8C?ELL"
    "6FBB89G@<PF9EC:<F8=;>GDN>L"
    "DEACEFEGDFJADDGD>@=D0GCFFG"
    "9??A4D@?:JB??>:AI;;;@CBMBF"
    "<B9B8EC8:EB?@B<>C@<5<HCJAM"
    ":AAD7EG66OG@DA;CJ;==AECKA?"
    "<<>A7@AA=NE;=7=<F;;:ECE;MF"
    "7BBF2DDI6JIBCD<DMBCDGFEGHI"
    "8DAA:CH29JIAE=<DN==CHGCDNJ"
    ":?:?8:I@:IG=?D<9A>?7C?D;=F"
    ";>?@8AG<;JG<>9:9I=99DB>C>@"
    ":>>@6D@A;DB@AG=AC@>>4BGKC<"
)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns that pass their length test; whole text."""
    found = F.concat(
        when(F.rlike(text, F.lit(WORD)), matches(text, ASSIGN, "assign")),
        when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, "access")),
        when(F.rlike(text, F.lit("[0-9a-f]{24}")), matches(text, HEX, "hex")),
    )
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1))
    return F.filter(
        found,
        lambda s: F.when(s["kind"] == "assign", value(s) >= LEAST_ASSIGN)
        .when(s["kind"] == "access", F.length(s["match"]) >= LEAST_ACCESS)
        .otherwise(True),
    )


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal is above ``z`` (a rational approximation good to about 1e-7)."""

    def tail(x: Column) -> Column:
        t = 1 / (1 + 0.3275911 * x / math.sqrt(2))
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return 0.5 * poly * F.exp(-x * x / 2)

    return let(z, lambda x: F.when(x >= 0, tail(x)).otherwise(1 - tail(-x)))


def encoding(token: Column) -> Column:
    """The smallest alphabet that spells the token; url-safe base64 counts as base64."""
    out = F.when(F.rlike(token, F.lit("^[0-9]+$")), "digits")
    some = {
        "hex": "0-9a-f", "upper hex": "0-9A-F", "lower": "a-z", "upper": "A-Z", "base32": "A-Z2-7", "base36": "0-9a-z",
        "upper base36": "0-9A-Z",
    }
    for name, letters in some.items():
        out = out.when(F.rlike(token, F.lit(f"^[{letters}]+$")), name)
    return out.otherwise("base64")


def battery(token: Column) -> Column:
    """Tests of one token: ``n``, ``chance`` (of the least of the three tests, three times, 1 at most), ``evidence``.

    The tests take the token as independent uniform draws from its alphabet: chi-squared of the
    character counts (normal by the cube-root transformation), runs above and below the middle of the
    alphabet, and lag-one serial correlation of the places in the alphabet. ``evidence`` is ln of how much
    likelier those draws make the token than ordinary text does (see ``text_cost``).
    """

    def measured(d: Column) -> Column:
        token, alphabet = d["token"], d["alphabet"]
        n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
        squares = F.aggregate(
            F.array_distinct(d["chars"]),
            F.lit(0.0),
            lambda acc, c: acc + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)),
        )
        places = F.transform(d["chars"], lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        cost = text_cost(d["chars"])
        return let(F.struct(n.alias("n"), k.alias("k"), squares.alias("squares"), places.alias("v"), cost.alias("cost")), tests)

    def tests(d: Column) -> Column:
        n, k, v = d["n"], d["k"], d["v"]
        chi = k / n * d["squares"] - n
        free = k - 1
        cube = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
        pairs = lambda values, f: F.zip_with(
            F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), f
        )
        high = F.transform(v, lambda x: (x >= k / 2).cast("double"))
        changed = let(high, lambda h: F.struct(add(h).alias("ones"), add(pairs(h, lambda a, b: F.abs(a - b))).alias("moves")))
        runs = let(changed, lambda c: _runs(n, c["ones"], c["moves"] + 1))
        serial = let(
            let(add(v) / n, lambda mean: F.transform(v, lambda x: x - mean)),
            lambda e: F.when(
                add(F.transform(e, lambda x: x * x)) > 0,
                (add(pairs(e, lambda a, b: a * b)) / add(F.transform(e, lambda x: x * x)) + 1 / n) * F.sqrt(n),
            ).otherwise(F.sqrt(n)),
        )
        least = F.least(upper_tail(cube), 2 * upper_tail(F.abs(runs)), 2 * upper_tail(F.abs(serial)))
        return F.struct(
            n.cast("int").alias("n"),
            F.least(F.lit(1.0), 3 * least).alias("chance"),
            (d["cost"] - n * F.log(k) - math.log(len(ALPHABETS))).alias("evidence"),
        )

    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    names = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    return let(
        bare,
        lambda b: let(
            F.struct(b.alias("token"), names[encoding(b)].alias("alphabet"), F.split(b, "", F.lit(-1)).alias("chars")),
            lambda d: measured(
                d.withField("chars", F.filter(d["chars"], lambda c: c != ""))  # a split at every place may leave an empty end
            ),
        ),
    )


def _runs(n: Column, ones: Column, runs: Column) -> Column:
    zeros = n - ones
    mean = 2 * ones * zeros / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    # All on one side: as far from random as the length allows.
    return F.when(spread > 0, (runs - mean) / F.sqrt(spread)).otherwise(-F.sqrt(n))


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def text_cost(chars: Column) -> Column:
    """-ln of the chance of the characters in ordinary text.

    Text goes on in its class (lower, upper, digit, other) or changes it, at the rate that suits this token best;
    letters follow letters as ``LETTERS`` says, digits are even. All values are fixed, so no other token of the
    table has a say. Draws from an alphabet beat text by a factor x at most once in x ordinary tokens (Markov).
    """
    kinds = F.transform(
        chars, lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)
    )
    letters = F.transform(chars, lambda c: F.instr(F.lit(LOWER), F.lower(c)))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    pairs = lambda values, f: F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), f)

    def total(d: Column) -> Column:
        changes = F.size(F.filter(pairs(d["kinds"], lambda a, b: a != b), lambda x: x))
        stays = F.size(d["kinds"]) - 1 - changes
        path = F.least(*[changes * -math.log(r / 3) + stays * -math.log(1 - r) for r in CHANGE_RATES])
        before = F.concat(F.array(F.lit(0)), d["letters"])
        spelt = F.zip_with(
            F.slice(before, 1, F.size(d["letters"])),
            d["letters"],
            lambda a, b: F.when(b > 0, (F.ascii(F.substr(F.lit(LETTERS), a * 26 + b, F.lit(1))) - ord("0")) / 4).otherwise(0.0),
        )
        rest = F.transform(d["kinds"], lambda k: F.when(k == 2, math.log(10)).when(k == 3, math.log(2)).otherwise(0.0))
        return path + add(spelt) + add(rest)

    return let(F.struct(kinds.alias("kinds"), letters.alias("letters")), total)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, tokens``: spans of the fixed patterns, and the tested tokens. One scan, no shuffle."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = when(F.rlike("text", F.lit("[A-Za-z0-9+/_-]{20}")), matches(F.col("text"), TOKEN, "random"))
    rows = rows.select("doc_id", base_spans(F.col("text")).alias("base"), tokens.alias("found"))
    tested = F.transform(
        "found", lambda s: F.struct(s["start"], s["end"], s["kind"], battery(s["match"]).alias("test"))
    )
    slim = F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return landed(rows.select("doc_id", slim.alias("base"), tested.alias("tokens")), "secret-candidates")


def discovery_steps(tokens: DataFrame) -> dict[int, int]:
    """By length class the least -ln p (in steps) that is a discovery: Benjamini and Hochberg over all tokens.

    The chances are counted in steps, rounded against discovery, so no sort of all tokens is needed.
    """
    rows = tokens.groupBy("length", "step").count().collect()  # at most 6 x 2001 rows
    out = {}
    for i in range(len(LENGTHS)):
        steps = sorted(((r.step, r["count"]) for r in rows if r.length == i), reverse=True)
        total, seen, out[i] = sum(n for _, n in steps), 0, MOST_STEPS + 1
        for step, n in steps:
            seen += n
            if math.exp(-step / STEPS) <= FALSE_SHARE * seen / total:
                out[i] = step
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` (arrays of start, kind, end), one row per row of ``docs``.

    ``base`` are the passing matches of the fixed patterns. ``spans`` are those and the tokens that
    look like random draws from their alphabet and are far likelier so than as ordinary text,
    at the allowed share of false discoveries within their length class; these never overlap base
    spans. Null texts are empty; null ids are kept; repeated rows repeat; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = candidates(docs)
    tokens = rows.select(F.explode("tokens.test").alias("t")).select("t.*").withColumn("length", length_class(F.col("n")))
    # A token that the battery rejects is no discovery, whatever text says of it.
    step = lambda t: F.when(
        t["chance"] >= LEAST_CHANCE,
        F.least(F.greatest(F.floor(t["evidence"] * STEPS), F.lit(0)).cast("int"), F.lit(MOST_STEPS)),
    ).otherwise(0)
    counted = tokens.select("length", step({c: F.col(c) for c in ("chance", "evidence")}).alias("step"))
    least_of = F.create_map(*[F.lit(x) for pair in discovery_steps(counted).items() for x in pair])
    added = F.filter(
        "tokens",
        lambda s: (s["test"]["chance"] >= LEAST_CHANCE) & (step(s["test"]) >= least_of[length_class(s["test"]["n"])]),
    )
    slim = F.transform(added, lambda s: F.struct(s["start"], s["end"], s["kind"]))
    spans = F.concat("base", apart(slim, F.col("base")))
    return rows.select("doc_id", ordered(F.col("base"), KINDS).alias("base"), ordered(spans, KINDS).alias("spans"))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
