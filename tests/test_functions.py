from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy, number, period, subject, text


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'date' if isinstance(v, date) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, value, bound",
    [
        ("1,23,456", 123456.0, None), ("(249.1)", -249.1, None), ("Rs. (249.1) crore", -249.1, None), ("three (3) directors", 3.0, None), ("5-7", 6.0, None), ("~ 12", 12.0, "approximate"),
        ("over 5", 5.0, "lower_bound"), ("up to 9", 9.0, "upper_bound"), ("FY 2019-20", 2019.0, None), ("none", None, None), (None, None, None), ("-3.5%", -3.5, None),
    ],
)
def test_parse_number(spark, raw, value, bound):
    got = one(spark, number.parse_number("v"), v=raw)
    assert got.value == value and got.bound == bound


@pytest.mark.parametrize(
    "raw, factor, label",
    [("2 lakh crore", 1e12, "lakh crore"), ("3 Mn", 1e6, "mn"), ("5m", 1e6, "m"), ("plan b", 1.0, None), ("Rs 4 cr.", 1e7, "cr."), ("7 '000", 1e3, "'000"), ("crisis", 1.0, None)],
)
def test_detect_magnitude(spark, raw, factor, label):
    got = one(spark, number.detect_magnitude("v"), v=raw)
    assert (got.factor, got.label) == (factor, label)


@pytest.mark.parametrize(
    "unit, raw, want",
    [
        ("", "4 per cent", ("percent", "ratio")), ("metric tonnes", "4", ("tonne", "mass")), ("$", "4", ("USD", "currency")), ("", "$ 4 percent", ("percent", "ratio")),
        ("sq. ft.", "9", ("sq_ft", "area")), ("", "9", (None, None)), ("m", "9", (None, None)), ("", "5 m", ("m", "length")),
    ],
)
def test_canonical_unit(spark, unit, raw, want):
    got = one(spark, number.canonical_unit("u", "v"), u=unit, v=raw)
    assert (got.unit, got.dimension) == want


def test_normalize_value(spark):
    got = one(spark, number.normalize_value("v", "u", F.lit("numeric")), v="1.4 Mn Tons", u="")
    assert (got.value_num, got.unit_canonical, got.magnitude) == (1400000.0, "tonne", 1e6)
    ratio = one(spark, number.normalize_value("v", "u", F.lit("numeric")), v="4 % of 2 mn", u="")
    assert (ratio.value_num, ratio.magnitude_label) == (4.0, None)


@pytest.mark.parametrize(
    "label, start, end, basis",
    [
        ("Q4 FY24", date(2024, 1, 1), date(2024, 3, 31), "fiscal_in"), ("H1 FY 2023-24", date(2023, 4, 1), date(2023, 9, 30), "fiscal_in"), ("9M FY25", date(2024, 4, 1), date(2024, 12, 31), "fiscal_in"),
        ("CY2023", date(2023, 1, 1), date(2023, 12, 31), "calendar"), ("2022-23", date(2022, 4, 1), date(2023, 3, 31), "fiscal_in"), ("2019-23", date(2019, 1, 1), date(2023, 12, 31), "calendar"),
        ("31 March 2022", date(2022, 3, 31), date(2022, 3, 31), "point_in_time"), ("as of March 2017", date(2017, 3, 31), date(2017, 3, 31), "point_in_time"), ("2016", date(2016, 1, 1), date(2016, 12, 31), "calendar"),
        ("Q4 2024", date(2024, 10, 1), date(2024, 12, 31), "calendar"), ("Feb 24", date(2024, 2, 1), date(2024, 2, 29), "calendar"), ("soon", None, None, "unknown"), (None, None, None, "unknown"),
    ],
)
def test_parse_period(spark, label, start, end, basis):
    got = one(spark, period.parse_period("v"), v=label)
    assert (got.start, got.end, got.basis) == (start, end, basis)


def test_period_relations(spark):
    days = dict(a=date(2023, 1, 1), b=date(2023, 12, 31), c=date(2023, 4, 1), d=date(2023, 6, 30))
    c = [F.col(x) for x in "abcd"]
    assert one(spark, period.period_contains(*c), **days) and not one(spark, period.periods_equal(*c), **days) and one(spark, period.periods_overlap(*c), **days)
    assert one(spark, period.period_contains(c[0], c[1], c[0], c[1]), **days) is False


@pytest.mark.parametrize("raw, want", [("The Foo Co. Ltd", "foo"), ("Foo Ltd Co", "foo ltd"), ("Délhi (X) Private Limited.", "delhi"), ("A & B, Inc.", "a & b"), ("", "")])
def test_canonical_subject(spark, raw, want):
    assert one(spark, subject.canonical_subject("v"), v=raw) == want


def test_scope(spark):
    assert one(spark, subject.normalize_scope_tags("v"), v=["Consol", " YoY.", "new tag", "consolidated"]) == ["consolidated", "new_tag", "year_on_year"]
    assert one(spark, subject.scope_shift(F.col("a"), F.col("b")), a=["standalone"], b=["consolidated"]) == ["standalone versus consolidated"]
    assert one(spark, subject.scope_shift(F.col("a"), F.col("b")), a=["total"], b=["total"]) == []
    assert "reported present on one side only" in one(spark, subject.scope_shift(F.col("a"), F.col("b")), a=["reported"], b=[])


def test_address_and_type(spark):
    got = one(spark, subject.normalize_address("v"), v="12 MG Rd., Sec 5, Gurugram 122001")
    assert got.postal_code == "122001" and got.normalized == "12 MG ROAD SECTOR 5 GURUGRAM"
    for raw, want in {"12 MG Road 122001": "address", "Foo Limited": "organisation", "Dr. jane": "person", "Jane Doe": "person_or_organisation", "growth of rice": "concept"}.items():
        assert one(spark, subject.guess_entity_type("v"), v=raw) == want


def test_text(spark):
    assert one(spark, text.clean_text("v"), v="a  b – c") == "a b - c"
    assert one(spark, text.clean_text("v", exact=True), v="ﬁne") == "fine"
    assert one(spark, text.canonical_predicate("v"), v="The Rate of Growth of") == "rate_of_growth"
    assert one(spark, text.strip_markdown("v"), v="## **Head** | x") == "Head   x"
    import hashlib

    assert one(spark, text.digest("a", "b"), a="a", b="b") == hashlib.sha256(b"a\0b").hexdigest()


def test_tolerance(spark):
    c = [F.col(x) for x in "pqab"]
    assert one(spark, number.relative_tolerance(*c), p="1.4 Mn", q="1,429 thousand", a=1.4e6, b=1.429e6) == pytest.approx(50000 / 1.429e6)
    assert one(spark, number.relative_tolerance(*c), p="1.00", q="1.01", a=1.0, b=1.01) == 0.005


def test_fuzzy():
    assert fuzzy.ratio("logistica", "logisticca") == pytest.approx(94.7, abs=0.1)
    assert fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("a b", "a b c") == 100 and fuzzy.token_set_ratio("", "a") == 0
    score, s, e = fuzzy.partial_ratio("quick brown fox", "the quick browm fox jumps")
    assert score > 90 and "the quick browm fox jumps"[s:e].strip().startswith("quick")
    brute = max(fuzzy.ratio("quick brown fox", "the quick browm fox jumps"[i : i + 15]) for i in range(11))
    assert score == pytest.approx(brute)
    assert fuzzy.lcs_length("", "abc") == 0
