"""Queries over literal inputs: what the column functions and the rule chain must give for the cases they are defined by.

Each case states its input and its result; the query runs the operator on the inputs, its SQL is the table of the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fuzzy, number, period, subject, text
from factloom.operators import chunking, entities, facts, judge, rules, verify
from factloom.session import materialise, ship

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
_SQL = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "int": "INTEGER", "bigint": "BIGINT"}


def _cell(v, kind: str) -> str:
    if v is None:
        body = "NULL"
    elif isinstance(v, str | date):
        body = "'" + str(v).replace("'", "''") + "'"
    else:
        body = repr(v) if not isinstance(v, bool) else str(v).lower()
    return f"CAST({body} AS {_SQL[kind]})"


def cases(given: str, result: str, rows: list[tuple]):
    """Registers a query: ``given`` and ``result`` are schemas, each row is an input followed by its result."""
    ins, outs = given.count(":"), [c.split(":") for c in result.split(", ")]
    ddl = ", ".join(c.replace(":", " ", 1) for c in given.split("; "))
    ins = len(given.split("; "))

    def register(f: Callable[[DataFrame], list[Column]]):
        def query(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            df = spark.createDataFrame([(i, *r[:ins]) for i, r in enumerate(rows)], f"case_no int, {ddl}")
            got = f(df)
            if isinstance(got, DataFrame):
                return got.select("case_no", *[F.col(n).cast(k).alias(n) for n, k in outs])
            return df.select("case_no", *[c.cast(k).alias(n) for c, (n, k) in zip(got, outs)])

        names = ", ".join(["case_no", *[n for n, _ in outs]])
        body = ", ".join("(" + ", ".join([_cell(i, "int"), *[_cell(v, k) for v, (_, k) in zip(r[ins:], outs)]]) + ")" for i, r in enumerate(rows))
        _ALL[f.__name__] = (query, f"SELECT {names} FROM (VALUES {body}) t({names})")
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _ALL.items()}


# Numbers, scales, units -------------------------------------------------------------------------------------------------


@cases("raw:string", "value:double, bound:string, low:double, high:double, negative:boolean, place:double", [
    ("8,142", 8142.0, None, None, None, False, 1.0),
    ("1,00,000", 100000.0, None, None, None, False, 1.0),
    ("1,000,000", 1000000.0, None, None, None, False, 1.0),
    ("12.75", 12.75, None, None, None, False, 0.01),
    ("-3.2", -3.2, None, None, None, False, 0.1),
    ("(452)", -452.0, None, None, None, True, 1.0),
    ("₹(452) Cr", -452.0, None, None, None, True, 1.0),
    ("(6.3%)", -6.3, None, None, None, True, 0.1),
    ("0", 0.0, None, None, None, False, 1.0),
    ("(1,234.5)", -1234.5, None, None, None, True, 0.1),
    ("Rs. (249.1) crore", -249.1, None, None, None, True, 0.1),
    ("$(1.2) billion", -1.2, None, None, None, True, 0.1),
    ("INR (133)", -133.0, None, None, None, True, 1.0),
    ("(133) crore", -133.0, None, None, None, True, 1.0),
    ("three (3)", 3.0, None, None, None, False, 1.0),
    ("ten (10)", 10.0, None, None, None, False, 1.0),
    ("approximately 12.5", 12.5, "approximate", None, None, False, 0.1),
    ("~1.4", 1.4, "approximate", None, None, False, 0.1),
    ("over 8,000", 8000.0, "lower_bound", None, None, False, 1.0),
    ("at least 25", 25.0, "lower_bound", None, None, False, 1.0),
    ("less than 5", 5.0, "upper_bound", None, None, False, 1.0),
    ("6.3 to 6.8", 6.55, None, 6.3, 6.8, False, 0.1),
    ("not a number at all", None, None, None, None, False, None),
    ("", None, None, None, None, False, None),
    (None, None, None, None, None, False, None),
])
def literal_numbers(df):
    n = number.parse_number("raw")
    return [n["value"], n["bound"], n["low"], n["high"], n["negative"], number.digit_place("raw")]


@cases("raw:string; unit:string", "factor:double, label:string, currency:string", [
    ("8,142 Cr", "", 1e7, "cr", None),
    ("₹15 crore", "", 1e7, "crore", "INR"),
    ("5 lakh", "", 1e5, "lakh", None),
    ("1.4 Mn", "", 1e6, "mn", None),
    ("2.8 Bn+", "", 1e9, "bn", None),
    ("1,429", "thousand tonnes", 1e3, "thousand", None),
    ("12 trillion", "", 1e12, "trillion", None),
    ("3.5 lakh crore", "", 1e12, "lakh crore", None),
    ("8,142", "", 1.0, None, None),
    ("the m and b of it", "", 1.0, None, None),
    ("740 m", "", 1e6, "m", None),
    ("₹8,142 Cr", "", 1e7, "cr", "INR"),
    ("Rs. 500", "", 1.0, None, "INR"),
    ("INR 12", None, 1.0, None, "INR"),
    ("US$ 4.2 bn", "", 1e9, "bn", "USD"),
    ("$300 million", "", 1e6, "million", "USD"),
    ("EUR 10", "", 1.0, None, "EUR"),
])
def literal_magnitudes(df):
    m = number.detect_magnitude("raw", "unit")
    return [m["factor"], m["label"], number.detect_currency("raw", "unit")]


@cases("unit:string; raw:string", "name:string, dimension:string", [
    ("Mn Tons", "1.4", "tonne", "mass"),
    ("thousand tonnes", "1,429", "tonne", "mass"),
    ("", "1.6%", "percent", "ratio"),
    ("per cent", "6.3", "percent", "ratio"),
    ("bps", "25", "bps", "ratio"),
    ("", "₹8,142 Cr", "INR", "currency"),
    ("sq ft", "20,000", "sq_ft", "area"),
    ("days", "45", "day", "duration"),
    ("shipments", "740", "count", "count"),
    ("", "a chairman", None, None),
])
def literal_units(df):
    u = number.canonical_unit("unit", "raw")
    return [u["unit"], u["dimension"]]


@cases("value:double; unit:string; to:string", "converted:double", [
    (1.0, "tonnes", "kg", 1000.0),
    (25.0, "bps", "percent", 0.25),
    (1.0, "tonnes", "days", None),
    (2.0, "km", "metres", 2000.0),
    (3.0, "nothing known", "kg", None),
])
def literal_conversions(df):
    a, b = number.canonical_unit("unit"), number.canonical_unit("to")
    return [F.round(number.convert(F.col("value"), a["to_base"], a["dimension"], b["to_base"], b["dimension"]), 9)]


@cases("a:string; b:string", "comparable:boolean", [("mass", "mass", True), (None, None, True), ("mass", None, False), ("mass", "area", False)])
def literal_dimensions(df):
    return [number.dimensions_comparable(F.col("a"), F.col("b"))]


@cases("raw:string; unit:string; kind:string", "value_num:double, unit_name:string, magnitude:double, label:string, currency:string", [
    ("1.4 Mn Tons", "", "numeric", 1400000.0, "tonne", 1e6, "mn", None),
    ("1,429", "thousand tonnes", "numeric", 1429000.0, "tonne", 1e3, "thousand", None),
    ("₹8,142 Cr", "", "numeric", 8.142e10, "INR", 1e7, "cr", "INR"),
    ("1.6%", "per cent", "numeric", 1.6, "percent", 1.0, None, None),
    ("Gurugram", "", "string", None, None, None, None, None),
])
def literal_values(df):
    v = number.normalize_value("raw", "unit", "kind")
    return [F.round(v["value_num"], 3), v["unit_canonical"], v["magnitude"], v["magnitude_label"], v["currency"]]


@cases("raw_a:string; raw_b:string; a:double; b:double", "delta:double, agrees:boolean", [
    ("1.4", "1,429", 1400000.0, 1429000.0, 0.020294, True),
    ("1.4", "1.9", 1.4, 1.9, 0.263158, False),
    ("578", "579", 578.0, 579.0, 0.001727, True),
    ("0", "0", 0.0, 0.0, 0.0, True),
])
def literal_tolerances(df):
    d = number.relative_delta(F.col("a"), F.col("b"))
    return [F.round(d, 6), d <= number.relative_tolerance(F.col("raw_a"), F.col("raw_b"), F.col("a"), F.col("b"))]


@cases("x:double", "short:string", [(81420000000.0, "81.42 B"), (1429000.0, "1.429 M"), (15000000.0, "1.5 Cr"), (2500.0, "2.5 K"), (3e12, "3 T"), (None, "")])
def literal_short_numbers(df):
    return [number.short_number("x")]


@cases("v:array<double>", "x:double, y:double", [([3.0, 4.0], 0.6, 0.8), ([0.0, 0.0], 0.0, 0.0), ([-2.0, 0.0], -1.0, 0.0)])
def literal_unit_vectors(df):
    n = number.unit_norm("v")
    return [F.round(n[0], 9), F.round(n[1], 9)]


# Periods ----------------------------------------------------------------------------------------------------------------

_FY24 = (date(2023, 4, 1), date(2024, 3, 31), "fiscal_in")


@cases("label:string", "starts:date, ends:date, basis:string", [
    ("FY24", *_FY24), ("FY 2023-24", *_FY24), ("FY2023-24", *_FY24),
    ("2024-25", date(2024, 4, 1), date(2025, 3, 31), "fiscal_in"),
    ("Q4 FY24", date(2024, 1, 1), date(2024, 3, 31), "fiscal_in"),
    ("Q1 FY24", date(2023, 4, 1), date(2023, 6, 30), "fiscal_in"),
    ("H1 FY24", date(2023, 4, 1), date(2023, 9, 30), "fiscal_in"),
    ("9M FY24", date(2023, 4, 1), date(2023, 12, 31), "fiscal_in"),
    ("CY2024", date(2024, 1, 1), date(2024, 12, 31), "calendar"),
    ("2024", date(2024, 1, 1), date(2024, 12, 31), "calendar"),
    ("March 2024", date(2024, 3, 1), date(2024, 3, 31), "calendar"),
    ("as of March 31, 2024", date(2024, 3, 31), date(2024, 3, 31), "point_in_time"),
    ("as at 31 March 2024", date(2024, 3, 31), date(2024, 3, 31), "point_in_time"),
    ("as on 2024-03-31", date(2024, 3, 31), date(2024, 3, 31), "point_in_time"),
    ("sometime recently", None, None, "unknown"),
])
def literal_periods(df):
    p = period.parse_period("label")
    return [p["start"], p["end"], p["basis"]]


@cases("a:string; b:string", "overlap:boolean, holds:boolean, held:boolean, equal:boolean", [
    ("FY24", "Q4 FY24", True, True, False, False),
    ("FY24", "FY23", False, False, False, False),
    ("FY24", "FY 2023-24", True, False, False, True),
    ("FY24", "sometime", False, False, False, False),
    ("H1 FY24", "CY2023", True, False, True, False),
])
def literal_period_relations(df):
    p, q = period.parse_period("a"), period.parse_period("b")
    days = (p["start"], p["end"], q["start"], q["end"])
    return [period.periods_overlap(*days), period.period_contains(*days), period.period_contains(*days[2:], *days[:2]), period.periods_equal(*days)]


@cases("x:string", "day:date", [("2024-03-31", date(2024, 3, 31)), ("2024-03-31T10:00:00", date(2024, 3, 31)), ("31/03/2024", None), ("", None), (None, None), ("2024-02-30", None)])
def literal_dates(df):
    return [text.tolerant_date("x")]


# Scopes, subjects, addresses --------------------------------------------------------------------------------------------


@cases("tags:array<string>", "normal:string", [
    (["Adj.", "Consolidated"], "adjusted,consolidated"),
    (["Pro Forma"], "pro_forma"),
    (["Excluding One Off Items"], "excluding_one_off_items"),
    (None, ""),
])
def literal_scopes(df):
    return [F.array_join(subject.normalize_scope_tags("tags"), ",")]


@cases("a:string; b:string", "shifted:boolean", [
    ("adjusted", "reported", True), ("standalone", "consolidated", True), ("estimate", "provisional", True), ("segment", "total", True),
    ("since_inception", "total", True), ("reported", "reported", False),
])
def literal_scope_shifts(df):
    return [F.size(subject.scope_shift(F.array("a"), F.array("b"))) > 0]


@cases("raw:string; predicate:string", "name:string, canonical:string", [
    ("Foobar Limited", "Revenue from services", "foobar", "revenue_from_services"),
    ("Foobar Ltd.", "  EBITDA Margin  ", "foobar", "ebitda_margin"),
    ("  The  Reserve Bank of India ", "the real GDP growth of", "reserve bank of india", "real_gdp_growth"),
    ("Acme Private Limited", "", "acme", ""),
    ("Express Parcel (segment)", "", "express parcel", ""),
])
def literal_subjects(df):
    return [subject.canonical_subject("raw"), text.canonical_predicate("predicate")]


@cases("raw:string", "postal:string, road:boolean, floor:boolean", [
    ("Plot 5, 2nd Flr, MG Rd., Bengaluru - 560001", "560001", True, True),
    ("12, MG Road", None, True, False),
])
def literal_addresses(df):
    a = subject.normalize_address("raw")
    return [a["postal_code"], F.array_contains(a["tokens"], "ROAD"), F.array_contains(a["tokens"], "FLOOR")]


@cases("raw:string", "kind:string", [
    ("Foobar Limited", "organisation"),
    ("N12-N14, Dock Road Centre, New Town 110037", "address"),
    ("Mr. Amit Rao", "person"),
    ("real gdp growth", "concept"),
])
def literal_entity_types(df):
    return [subject.guess_entity_type("raw")]


@cases("a:string; b:string", "compatible:boolean", [("person", "person", True), ("person", "organisation", False), ("person", "unknown", True), ("concept", "address", True)])
def literal_type_pairs(df):
    return [subject.types_compatible(F.col("a"), F.col("b"))]


@cases("subject:string; guess:string", "candidate:string, score:double, decision:string", [
    ("acme logistics", "organisation", None, None, None),
    ("acme logistic services", "organisation", "acme logistics services", 97.8, None),
    ("northern mineral holdings", "organisation", "northern minerals holding", 96.0, None),
    ("northn minerals holding", "organisation", "northern minerals holding", 95.8, None),
    ("nrthn minerals holding", "organisation", "northern minerals holding", 93.6, "merged"),
    ("nrthn mnerals holdng", "organisation", "northern minerals holding", 88.9, "kept_separate"),
])
def literal_close_calls(df):
    """Ratios near the bound of merging: two insertions or deletions of 47 letters are 200 * 22 / 47 and so on."""
    spark = df.sparkSession
    known = spark.createDataFrame([("acme logistics services", "e1", "organisation"), ("northern minerals holding", "e2", "organisation")], "name string, entity_id string, kind string")
    names = df.select(F.col("subject").alias("name"), "guess")
    calls = entities.close_calls(names, known).select("subject", "candidate", "decision")
    best = entities.similar_entities(names, known, 86.0).select(F.col("name").alias("subject"), F.col("other"), F.round("score", 1).alias("score"))
    return df.join(best, "subject", "left").join(calls, "subject", "left").select("case_no", F.col("other").alias("candidate"), "score", "decision")


# Wording, quotes, chunks ------------------------------------------------------------------------------------------------


@cases("a:string; b:string", "plain:double, sorted_words:double, word_sets:double", [
    ("abcd", "abcd", 100.0, 100.0, 100.0),
    ("abcd", "abxd", 75.0, 75.0, 75.0),
    ("new york mets", "mets new york", 61.538, 100.0, 100.0),
    ("fuzzy was a bear", "fuzzy fuzzy was a bear", 84.211, 84.211, 100.0),
    ("", "", 100.0, 100.0, 0.0),
    ("abc", "", 0.0, 0.0, 0.0),
])
def literal_ratios(df):
    plain = F.pandas_udf(lambda a, b: a.combine(b, fuzzy.ratio), "double")
    return [F.round(x, 3) for x in (plain("a", "b"), fuzzy.token_sort(F.col("a"), F.col("b")), fuzzy.token_set(F.col("a"), F.col("b")))]


CHUNK = "Performance highlights\n\nFY24 revenue from services was Rs 8,142 Cr, up 12.7 per cent year on year.\nPTL freight tonnage in FY24 stood at 1.4 Mn Tons.\n"


@cases("quote:string; text:string", "method:string, found:boolean, exact_text:boolean", [
    ("Rs 8,142 Cr", CHUNK, "exact", True, True),
    ("FY24 revenue    from services\n was Rs 8,142 Cr", CHUNK, "normalized", True, False),
    ("PTL freight tonnage in FY24 stood at 1.42 Mn Tons", CHUNK, "fuzzy", True, False),
    ("The company operates nuclear submarines worldwide", CHUNK, "fuzzy_failed", False, False),
    ("Cr", CHUNK, "too_short", False, False),
    ("Revenue 8,142 Cr | up 12%", "**Revenue** | 8,142 Cr | up 12%", "markup_insensitive", True, False),
    (None, CHUNK, "too_short", False, False),
])
def literal_quotes(df):
    got = verify.verify_quotes(df.select(F.col("case_no").alias("evidence_id"), "case_no", "quote"), df.select("case_no", "text"), "case_no")
    cut = F.expr("substring(text, cast(char_start + 1 as int), cast(char_end - char_start as int))")
    return df.join(got, df["case_no"] == got["evidence_id"]).select(df["case_no"], "method", F.col("verified").alias("found"), F.coalesce(cut == F.col("quote"), F.lit(False)).alias("exact_text"))


_TABLE = "| Year | Revenue | Cost |\n| --- | --- | --- |\n" + "".join(f"| FY{y} | {y}00 | {y}9 |\n" for y in range(10, 24))
_PROSE = "A sentence of some words that says little. " * 60


_SHORT = "One short page of prose that is long enough to be kept as a chunk, as it has more than one hundred and twenty letters in it."


@cases("page:string; slide:boolean", "n:int, kinds:string, longest:int, covers:boolean", [
    ("", False, 0, "", 0, True),
    ("   \n ", False, 0, "", 0, True),
    (_SHORT, False, 1, "prose", len(_SHORT), True),
    (_TABLE, False, 1, "table", len(_TABLE), True),
    (_PROSE[:1800], False, 1, "prose", 1800, True),
    (_PROSE, False, 2, "prose,prose", 41 * 43, True),
    (_PROSE, True, 1, "prose", len(_PROSE), True),
])
def literal_chunks(df):
    """Chunks of a page: a table stays whole, long prose overlaps, a short slide is one chunk, and nothing of the page is lost."""
    pages = df.select(F.col("case_no").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).cast("bigint").alias("char_start"), F.col("page").alias("text"), "slide")
    per = chunking.chunk_pages(pages, whole_col="slide").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("char_start", "char_end", "kind"))).alias("c"), F.max(F.length("text")).alias("longest")
    )
    rows = df.join(per, df["case_no"] == per["doc_id"], "left")
    whole = F.aggregate("c", F.lit(0).cast("bigint"), lambda at, x: F.when(x["char_start"] <= at, F.greatest(at, x["char_end"])).otherwise(at)) >= F.length("page")
    kinds = F.array_join(F.transform("c", lambda x: x["kind"]), ",")
    return rows.select("case_no", F.coalesce(F.size("c"), F.lit(0)).alias("n"), F.coalesce(kinds, F.lit("")).alias("kinds"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce(whole, F.lit(True)).alias("covers"))


@cases("text:string", "stripped:string, letters:int", [
    ("## **Net debt** | 12", "Net debt   12", 9),
    ("[table 1] __x__ ~~y~~", "x y", 8),
    ("", "", 0),
])
def literal_markdown(df):
    return [text.strip_markdown("text"), text.alnum_count("text")]


@cases("rows:array<array<string>>", "useful:boolean", [
    ([["Year", "Revenue"], ["FY24", "8142"]], True),
    ([["Year", "Revenue"]], False),
    ([["Year"], ["FY24"]], False),
    ([["a", None], [None, None]], False),
    ([["x", "x"], ["x", "x"]], False),
])
def literal_tables(df):
    return [chunking.table_is_useful("rows")]


@cases("tables:array<array<array<string>>>", "markdown:string", [
    ([[["Year", "Revenue"], ["FY24", "8142"]], [["x", "x"], ["x", "x"]], [["a", "b"], ["c", None]]], "[table 1]\n|Year|Revenue|\n|---|---|\n|FY24|8142|\n\n[table 3]\n|a|b|\n|---|---|\n|c||"),
    ([[["x"]]], ""),
])
def literal_table_markdown(df):
    return [facts.tables_markdown("tables")]


_W = lambda y, *words: [(10.0 * i, float(y), 10.0 * i + 8, float(y) + 10, w) for i, w in enumerate(words)]


@cases("words:array<struct<x0:double,y0:double,x1:double,y1:double,word:string>>", "label:string", [
    (_W(780, "Annual", "report", "12") + _W(10, "7"), "12"),
    (_W(10, "xiv") + _W(400, "99"), "xiv"),
    (_W(780, "|", "(3)") , "3"),
    (_W(400, "5"), None),
    (_W(780, "i", "text"), None),
    ([], None),
])
def literal_page_labels(df):
    return [facts.page_label("words", F.lit(0.0), F.lit(800.0))]


@cases("producer:string; title:string", "slides:boolean", [("Microsoft PowerPoint", None, True), ("LaTeX", "Results", False), (None, "made in Canva", True)])
def literal_slide_producers(df):
    return [facts.made_as_slides("producer", "title")]


@cases("x:string", "k:bigint", [('{"k": 3}', 3), ("{broken", 0), ("", 0), (None, 0), ('{"z": 1}', 0)])
def literal_json(df):
    got = text.decode_json("x", "k bigint", F.struct(F.lit(0).cast("bigint").alias("k")))
    return [F.coalesce(got["k"], F.lit(0))]


# Pairs of facts ---------------------------------------------------------------------------------------------------------

FACT = (
    "fact_id string, doc_id bigint, chunk_id string, entity_id string, predicate string, predicate_canonical string, value_raw string, value_type string, value_num double, value_text string, unit_raw string, "
    "unit_canonical string, unit_dimension string, currency string, period_start date, period_end date, period_label_raw string, scope_tags array<string>, qualifiers map<string,string>, evidence_id string, "
    "created_at timestamp_ntz, confidence double"
)


def fact(i: str, **k) -> tuple:
    base = dict(
        fact_id=i, doc_id=1, chunk_id="c" + i, entity_id="e", predicate="revenue", predicate_canonical="revenue", value_raw="100", value_type="numeric", value_num=100.0, value_text=None, unit_raw=None,
        unit_canonical="INR", unit_dimension="currency", currency="INR", period_start=date(2023, 4, 1), period_end=date(2024, 3, 31), period_label_raw="FY24", scope_tags=[], qualifiers={}, evidence_id="v" + i,
        created_at=datetime(2024, 1, 1), confidence=0.9,
    )
    return tuple((base | k).values())


def _n(v: float, raw: str | None = None, **k) -> dict:
    return dict(value_num=v, value_raw=raw or f"{v:g}", **k)


def _u(unit: str, dimension: str) -> dict:
    return dict(unit_canonical=unit, unit_dimension=dimension, currency=None)


_TEXT = dict(value_type="string", value_num=None, unit_canonical=None, unit_dimension=None, currency=None)
_Q4 = dict(period_start=date(2024, 1, 1), period_end=date(2024, 3, 31), period_label_raw="Q4 FY24")
_FY23 = dict(period_start=date(2022, 4, 1), period_end=date(2023, 3, 31), period_label_raw="FY23")
_AS_OF = (date(2025, 1, 31), date(2025, 5, 29))
#: (overrides of a, of b, dates of their documents, relation, step, confidence, explanation)
PAIRS = [
    ({}, _TEXT | dict(value_raw="x"), (None, None), "unrelated", "value_type", 0.95, "One value is numeric, the other string."),
    (_u("kg", "mass"), _u("day", "duration"), (None, None), "unrelated", "unit_dimension", 0.95, "The units measure different things: mass and duration."),
    (_u(None, None), dict(predicate_canonical="headcount"), (None, None), "unrelated", "predicate_without_dimension", 0.9, "Different predicates, and no common dimension to compare them by."),
    ({}, dict(currency="USD"), (None, None), "unrelated", "currency", 0.9, "Stated in INR and USD, without a rate of exchange."),
    ({}, dict(currency="USD", qualifiers={"exchange_rate": "83"}), (None, None), None, "currency_with_rate", 0.5, "Stated in INR and USD, with a rate of exchange: to be judged."),
    (_n(1400000.0, "1.4 Mn Tons") | _u("tonne", "mass"), _n(1429000000.0, "1,429,000,000") | _u("kg", "mass"), (None, None), "reconciled_by_unit", "unit_agreement", 0.9, "The same value in tonne and kg."),
    (_n(0.25) | _u("percent", "ratio"), _n(25.0) | _u("bps", "ratio"), (None, None), "reconciled_by_unit", "unit_agreement", 0.9, "The same value in percent and bps."),
    (_n(8142.0), _n(2076.0) | _Q4, (None, None), "refines", "period_nested", 0.9, "One period lies within the other: FY24 and Q4 FY24."),
    (_n(8142.0), _n(7225.0) | _FY23, (None, None), "reconciled_by_period", "period_disjoint", 0.92, "Different periods: FY24 and FY23."),
    (_n(127.0, scope_tags=["reported"]), _n(76.0, scope_tags=["adjusted"]), (None, None), "reconciled_by_scope", "scope", 0.85, None),
    (_n(127.0, scope_tags=["reported"]), _n(127.0, scope_tags=["adjusted"]), (None, None), "corroborates", "agreement", 0.9, "The values agree within the precision written, 0.00% apart."),
    (_n(6.4), _n(6.5), _AS_OF, "reconciled_by_vintage", "vintage", 0.85, "One claim from documents of different dates: 2025-01-31 and 2025-05-29."),
    (_n(1400000.0, "1.4 Mn Tons") | _u("tonne", "mass"), _n(1429000.0, "1,429") | _u("tonne", "mass"), (None, None), "corroborates", "agreement", 0.9, "The values agree within the precision written, 2.03% apart."),
    (_n(578.0), _n(579.0), (None, None), "corroborates", "agreement", 0.9, "The values agree within the precision written, 0.17% apart."),
    (_n(1000.0, "1,000"), _n(1010.0, "1,010"), (None, None), "corroborates", "minor_gap", 0.6, "The values are 0.99% apart, more than rounding but little."),
    (_n(8142.0), _n(6000.0), (None, None), None, "material_gap", 0.5, "The values are 26.31% apart, and neither unit, period, scope nor date explains it."),
    ({}, dict(value_num=None), (None, None), None, "numeric_values", 0.4, "A number is missing on one side."),
    (_TEXT | dict(value_raw="12 MG Road 122001"), _TEXT | dict(value_raw="12, MG Rd - 122001"), (None, None), "corroborates", "address", 0.9, "Two spellings of one address, with the same postal code."),
    (_TEXT | dict(value_raw="Foo Bar"), _TEXT | dict(value_raw="bar foo"), (None, None), "corroborates", "wording", 0.85, "The same wording, apart from order and spelling."),
    (_TEXT | dict(value_raw="Asha Rao"), _TEXT | _FY23 | dict(value_raw="Vikram Iyer"), (None, None), "reconciled_by_period", "wording_period", 0.8, "Different texts of different periods: FY24 and FY23."),
    (_TEXT | dict(value_raw="Asha Rao"), _TEXT | dict(value_raw="Vikram Iyer"), (None, None), None, "wording_unsettled", 0.5, "Different texts that nothing explains."),
    (dict(unit_canonical=None, unit_dimension=None, currency=None), {}, (None, None), "corroborates", "agreement", 0.9, "The values agree within the precision written, 0.00% apart."),
]


def _paired(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    rows, docs, pairs = [], [], []
    for i, (a, b, dates, *_) in enumerate(PAIRS):
        rows += [fact(f"{i:03d}a", **a | dict(doc_id=2 * i)), fact(f"{i:03d}b", **b | dict(doc_id=2 * i + 1))]
        docs += [(2 * i, dates[0]), (2 * i + 1, dates[1])]
        pairs.append((i, f"{i:03d}a", f"{i:03d}b"))
    held = spark.createDataFrame(pairs, "case_no int, fact_a string, fact_b string")
    return rules.evaluate_pairs(rules.pair_facts(held.drop("case_no"), spark.createDataFrame(rows, FACT), spark.createDataFrame(docs, "doc_id bigint, as_of_date date"))).join(held, ["fact_a", "fact_b"])


@cases("name:string", "relation:string, step:string, confidence:double, said:boolean, last:string", [
    (f"{i:03d}", r, s, c, True, r or "undecided") for i, (_, _, _, r, s, c, _) in enumerate(PAIRS)
])
def literal_rules(df):
    said = F.create_map(*[F.lit(x) for i, p in enumerate(PAIRS) if p[6] for x in (i, p[6])])
    got = materialise(_paired(df), "decided")
    return got.withColumns({"said": F.col("explanation").isNotNull() & F.coalesce(F.col("explanation") == F.try_element_at(said, F.col("case_no")), F.lit(True)), "last": F.element_at("trace", -1)["outcome"]})


def _stub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A judge that fails on pairs without a number and otherwise contradicts where the prompt names a material gap."""
    for b in batches:
        rows = [(i, None if "numeric_values" in p else "contradicts" if "material_gap" in p else "unrelated", 0.7, " seen: " + str(p.count("quote:"))) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.string()))], names=["link_id", "relation", "confidence", "explanation"])


_OPEN = [i for i, p in enumerate(PAIRS) if p[3] is None and p[4] != "numeric_values"]


@cases("name:string", "relation:string, decided_by:string, last:string, explanation:string", [
    (str(i), "contradicts" if PAIRS[i][4] == "material_gap" else "unrelated", "judge", "judge", "seen: 2") for i in _OPEN
])
def literal_judged(df):
    """The undecided pairs put to a stub of a judge; the pair it fails on is dropped."""
    spark = df.sparkSession
    sides = [fact(f"{i:03d}{s}", **PAIRS[i][k]) for i in range(len(PAIRS)) for k, s in enumerate("ab")]
    view = spark.createDataFrame(sides, FACT).select("*", F.lit("Acme").alias("subject_raw"), F.lit("A report").alias("document_title"), F.lit("f.pdf").alias("filename"), F.lit(None).cast("date").alias("as_of_date"), F.lit(3).alias("page_index"), F.lit("said so").alias("quote"))
    _, residue = rules.storable_links(materialise(_paired(df).drop("case_no"), "decided"))
    got = judge.judge_residue(residue, view, _stub, "stub", "v1")
    number_of = F.create_map(*[F.lit(x) for k, i in enumerate(_OPEN) for x in (f"{i:03d}a", k)])
    return got.select(number_of[F.col("fact_a")].alias("case_no"), "relation", "decided_by", F.element_at("trace", -1)["name"].alias("last"), "explanation")


@cases("subject:string; value_raw:string; unit_raw:string; label:string; guess:string; quote:string; note:string", (
    "name:string, value_num:double, period_start:date, basis:string, n_qualifiers:int, note_kept:string, method:string, page_index:int, page_label:string, quoted:boolean"
), [
    ("Foobar Limited", "Rs 8,142 Cr", "", "FY24", None, "Rs 8,142 Cr", None, "foobar", 8.142e10, date(2023, 4, 1), "fiscal_in", 1, None, "exact", 0, "1", True),
    ("Foobar Ltd.", "about 1.4", "Mn Tons", None, "FY23", "PTL freight tonnage", "rounded", "foobar", 1400000.0, date(2022, 4, 1), "as guessed", 3, "rounded", "exact", 1, "2", True),
    ("Acme", "12", None, None, None, "not said anywhere in this text", None, "acme", 12.0, None, "unknown", 1, None, "fuzzy_failed", 0, "1", False),
])
def literal_built_facts(df):
    """Raw output to facts and evidence: the stated period wins over the guess, the note is a qualifier, the quote decides the page."""
    spark = df.sparkSession
    raw = df.select(
        F.lit(7).cast("bigint").alias("doc_id"), F.lit("c7").alias("chunk_id"), "subject", F.lit("Revenue of").alias("predicate"), "value_raw", F.lit("numeric").alias("value_type"), "unit_raw", F.col("label").alias("period_label_raw"),
        F.col("guess").alias("period_start"), F.lit(None).cast("string").alias("period_end"), F.lit("as guessed").alias("period_basis"), F.array(F.lit("Adj.")).alias("scope_tags"),
        F.create_map(F.lit("region"), F.lit("all")).alias("qualifiers"), F.col("quote").alias("evidence_quote"), F.lit(0.8).alias("confidence"), F.col("note").alias("extraction_note"),
    )
    chunks = spark.createDataFrame([("c7", CHUNK, 0, 0)], "chunk_id string, text string, char_start bigint, page_index_start int")
    at = CHUNK.index("PTL")
    pages = spark.createDataFrame([(7, 0, "1", 0, at - 1, CHUNK[: at - 1]), (7, 1, "2", at, len(CHUNK), CHUNK[at:])], "doc_id bigint, page_index int, page_label string, char_start bigint, char_end bigint, text string")
    made, evidence = facts.build_facts(raw, chunks, pages)
    ids = facts.with_ids(raw.withColumn("case_no", F.monotonically_increasing_id())).select("fact_id", "value_raw").join(df.select("case_no", "value_raw"), "value_raw").drop("value_raw")
    e = evidence.select("fact_id", F.col("match_method").alias("method"), "page_index", "page_label", "verified", F.expr(f"substring({_cell(CHUNK, 'string').replace('VARCHAR', 'STRING')}, cast(char_start + 1 as int), cast(char_end - char_start as int)) = quote").alias("same"))
    both = made.drop("evidence_id").join(e, "fact_id").join(ids, "fact_id")
    return both.select(
        "case_no", F.col("subject_canonical").alias("name"), F.round("value_num", 3).alias("value_num"), "period_start", F.col("period_basis").alias("basis"), F.size("qualifiers").alias("n_qualifiers"),
        F.try_element_at("qualifiers", F.lit("extraction_note")).alias("note_kept"), "method", "page_index", "page_label", F.coalesce("same", F.lit(False)).alias("quoted"),
    )
