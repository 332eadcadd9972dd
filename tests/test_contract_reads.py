"""What a row costs in the contract check and a batch in its planning, and that cheap paths judge as the long ones do."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import contracts
from riskloom.operators.columns import prefill_columns
from riskloom.schema import RAW_COLUMNS, enum, integer, number

TEXTS = [
    "35", " 35 ", "+35", "-35", "25.0", "25.5", "1e2", "1e999", "-1e999", "35d", "3F", "0x1p3", "NaN", "Infinity", "-inf", "", " ",
    "\x7f35", "35\x7f", "\t35\n", " 35", "5.", ".5", "３５", "1_0", "--5", "35 5", "17", "100", "101", "9223372036854775807",
    "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "9007199254740993", "1e18", "1e19", "#", None,
]


def test_a_whole_number_is_read_as_a_double_once():
    held = contracts._holds(integer("a", ge=18, le=100), T.StringType())
    assert held.count("AS DOUBLE") == 1


def test_prefill_asks_for_the_columns_once():
    class Asked:
        times = 0

        @property
        def columns(self):
            self.times += 1
            return list(RAW_COLUMNS)

    df = Asked()
    assert prefill_columns(df, RAW_COLUMNS, []) is df
    assert df.times == 1


def test_odd_numbers_are_judged_as_before(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, a string")
    double = "try_cast(translate(trim(a), 'dDfFxXpPnN', '##########') AS DOUBLE)"
    fits = "(abs(d) < 9223372036854775808D OR (instr(a, '.') = 0 AND try_cast(a AS BIGINT) IS NOT NULL))"
    read = df.withColumn("d", F.expr(double)).withColumn("i", F.expr(f"IF(d = floor(d) AND {fits}, d, NULL)")).persist()
    cases = {
        integer("a"): "i IS NOT NULL", integer("a", ge=18, le=100): "i >= 18 AND i <= 100", integer("a", gt=0): "i > 0",
        number("a"): "d IS NOT NULL", number("a", ge=0, le=1): "d >= 0 AND d <= 1", number("a", gt=0): "d > 0",
        integer("a", ge=0, optional=True): "a IS NULL OR i >= 0",
    }
    for field, kept in cases.items():
        want = [r.row_id for r in read.filter(kept).orderBy("row_id").collect()]
        good, bad = contracts.split_valid(df, [field])
        assert [r.row_id for r in good.orderBy("row_id").collect()] == want, field
        broken = {r.row_id: [v.value for v in r.violations] for r in bad.collect()}
        assert broken == {k: [t] for k, t in enumerate(TEXTS) if k not in want}, field
    typed = contracts.typed_rows(df, [number("a")]).join(read.drop("a"), "row_id").filter("NOT a <=> d")
    assert typed.count() == 0
    read.unpersist()


def test_levels_in_other_spellings(spark):
    texts = ["Self-Employed", "self_employed", "SELF-employed", " Self-Employed", "Other", "other", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, a string")

    def kept(field):
        return {r.row_id: r.a for r in contracts.split_valid(df, [field])[0].collect()}

    own = "Self-Employed"
    assert kept(enum("a", (own,), "dash")) == {0: own, 1: own, 2: own}
    assert kept(enum("a", (own,), "trim")) == {0: own, 2: own, 3: own}
    # Of levels that fold to one text the last is meant; one with spaces around it is never met.
    assert kept(enum("a", ("Other", "other", " Self-Employed"), "trim")) == {4: "other", 5: "other"}


def test_numbers_that_are_typed_already(spark):
    df = spark.sql("SELECT id AS row_id, IF(id = 3, double('NaN'), IF(id = 4, NULL, id * 0.5D)) AS a FROM range(7)")
    good, bad = contracts.split_valid(df, [integer("a", ge=1, le=2)])
    assert {(r.row_id, r.a) for r in good.collect()} == {(2, 1)}
    assert bad.count() == 6
