import pytest
from pyspark.sql import functions as F

from tarn.functions import text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("Ladislav Kůň", "ladislav kun"), ("Mårten Öhman", "marten ohman"), ("Ota Borový *", "ota borovy"), ("", ""), (None, ""), ("   ", ""), ("A B\t C", "a b c")])
def test_names(spark, raw, want):
    assert one(spark, raw, text.normalize_name) == want


def test_exact_fold(spark):
    assert one(spark, "ﬁň", text.exact_fold) == "fin"


@pytest.mark.parametrize("raw,iso,year", [("1996-05-25", "1996-05-25", 1996), ("17.7.1990", "1990-07-17", 1990), ("1.5.2007", "2007-05-01", 2007), ("99.99.2000", "2000-99-99", 2000), ("", None, None), (None, None, None), ("x", None, None)])
def test_dates(spark, raw, iso, year):
    assert tuple(one(spark, raw, text.birth_date)) == (iso, year)


@pytest.mark.parametrize("raw,iso", [("( 2000-06-22 ) 22 June", "2000-06-22"), ("( 1990-6-5 )", "1990-06-05"), ("", None), ("just a name", None)])
def test_dates_in_parentheses(spark, raw, iso):
    assert one(spark, raw, text.date_in_parentheses).iso == iso


@pytest.mark.parametrize("raw,want", [("5,26", 5.26), ("56", 56.0), ("+4", 4.0), ("-", None), ("", None), (None, None), ("12 %", 12.0)])
def test_numbers(spark, raw, want):
    assert one(spark, raw, text.number) == want


@pytest.mark.parametrize("raw,want", [("Radko Gudas – A", "Radko Gudas"), ("Roman Červenka - C", "Roman Červenka"), ("Jan Novák", "Jan Novák")])
def test_marks(spark, raw, want):
    assert one(spark, raw, text.clean_name) == want


def test_small_ones(spark):
    assert one(spark, " x ", text.clean) == "x" and one(spark, " ", text.clean) is None
    assert one(spark, "Jiří Kulich jr.", text.slug) == "jiri-kulich-jr"
    assert one(spark, "2024-25", text.season_start) == 2024 and one(spark, 20242025, text.season_start, "long") == 2024 and one(spark, 2024, text.season_id, "int") == "20242025"
    assert tuple(one(spark, "Jan van Dyk", text.name_parts)) == ("Jan", "van Dyk")
    assert one(spark, 7, lambda x: text.person_id("nhl", x), "int") == "nhl-7"
    assert one(spark, 0.3456, text.signed, "double") == "+0,35"
    assert one(spark, "a " * 300, lambda x: text.excerpt(x, 320)).endswith("a…") and one(spark, "short", text.excerpt) == "short"
    assert one(spark, "a **b** c\n\nd", text.paragraphs) == "<p>a <strong>b</strong> c</p>\n<p>d</p>"


def test_brief(spark):
    got = one(spark, "```markdown\n# Jan Novak (F, 1990)\nlead\n## One\nText **b**.\n\nMore\n## Two\nx\n```", text.brief)
    assert (got.title, got.meta) == ("Jan Novak", "F, 1990")
    assert [(s.heading, s.html) for s in got.sections] == [("", "<p>lead</p>"), ("One", "<p>Text <strong>b</strong>.</p>\n<p>More</p>"), ("Two", "<p>x</p>")]


def test_binary_rounding(spark):
    values = [2.675, 0.125, 0.375, -2.675, 1.005, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.r for r in df.select(text.round_binary("v", 2).alias("r")).collect()] == [None if v is None else round(v, 2) for v in values]


def test_localized(spark):
    df = spark.sql("select named_struct('cs', 'Praha', 'default', 'Prague') c union all select named_struct('cs', '', 'default', 'Brno') union all select named_struct('cs', null, 'default', null)")
    assert {r.y for r in df.select(text.localized("c", "cs").alias("y")).collect()} == {"Praha", "Brno", None}


def test_rounding(spark):
    assert spark.range(1).select(F.round(F.lit(2.5)).alias("a"), text.round_half_even(F.lit(2.5), 0).alias("b")).first() == (3.0, 2.0)


def test_signs(spark):
    """Ties of the decimal text are judged by the binary value; null stays null, zero has a plus."""
    values = [0.125, 2.675, -2.675, 0.375, -0.0, -0.001, 1e22, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.r for r in df.select(text.signed("v").alias("r")).collect()] == ["+0,12", "+2,67", "-2,67", "+0,38", "+0,00", "-0,00", "+10000000000000000000000,00", None]
