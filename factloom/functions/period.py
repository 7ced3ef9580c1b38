"""Periods of time: labels to closed intervals of days, and how two intervals lie to one another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import _c, clean_text, let

#: Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_M = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
_FY = r"f\.?y\.?\s*'?\d{2,4}(?:\s*[-/]\s*\d{2,4})?"
_BARE = r"\d{4}(?:\s*[-/]\s*\d{2,4})?"
#: What period labels look like, in lower case.
PATTERNS = {
    "quarter": rf"\bq([1-4])\s*[:\-]?\s*(?:of\s*)?({_FY}|c\.?y\.?\s*\d{{4}}|{_BARE})",
    "half": rf"\bh([12])\s*[:\-]?\s*({_FY}|c\.?y\.?\s*\d{{4}}|{_BARE})",
    "months": rf"\b(\d{{1,2}})\s*m\s*[:\-]?\s*({_FY}|{_BARE})",
    "calendar": r"\b(?:c\.?y\.?|calendar\s+year)\s*(\d{4})\b",
    "fy_span": r"\bf\.?y\.?\s*(\d{4})\s*[-/]\s*(\d{2,4})\b",
    "fy": r"\bf\.?y\.?\s*'?(\d{4}|\d{2})\b",
    "iso": r"\b(\d{4})-(\d{2})-(\d{2})\b",
    "dmy": rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_M})\.?,?\s+(\d{{4}})\b",
    "mdy": rf"\b({_M})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b",
    "span": r"\b(\d{4})\s*[-/]\s*(\d{2})\b",
    "month": rf"\b({_M})\.?[\s,-]+(\d{{4}}|\d{{2}})\b",
    "year": r"\b((?:19|20)\d{2})\b",
}


def _int(x: Column) -> Column:
    return x.try_cast("int")


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(name, 1, 3)).cast("int")


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _year(start: Column, end: Column, fiscal: Column, first_month: int) -> tuple[Column, Column]:
    """(first day, last day) of a year labelled by its end, fiscal or calendar."""
    if first_month == 1:
        fiscal = F.lit(False)
    from_ = F.when(fiscal, F.make_date(end - 1, F.lit(first_month), F.lit(1))).otherwise(F.make_date(start, F.lit(1), F.lit(1)))
    to = F.when(fiscal, F.date_sub(F.make_date(end, F.lit(first_month), F.lit(1)), 1)).otherwise(F.make_date(end, F.lit(12), F.lit(31)))
    return from_, to


def _years(t: Column, first_month: int) -> Column:
    """struct<start, end, basis> of the year a label names: CY, FY span, FY, bare span, bare year; null if none."""
    g = lambda name, i: F.nullif(F.regexp_extract(t, PATTERNS[name], i), F.lit(""))
    named = F.struct(*[F.struct(g(n, 1).alias("a"), (g(n, 2) if n in ("fy_span", "span") else F.lit(None).cast("string")).alias("b")).alias(n) for n in ("calendar", "fy_span", "fy", "span", "year")])
    # (kind, first year, last year) as written
    pick = let(
        named,
        lambda x: F.when(x["calendar"]["a"].isNotNull(), F.struct(F.lit("calendar").alias("k"), x["calendar"]["a"].alias("a"), x["calendar"]["a"].alias("b")))
        .when(x["fy_span"]["a"].isNotNull(), F.struct(F.lit("fy_span").alias("k"), x["fy_span"]["a"].alias("a"), x["fy_span"]["b"].alias("b")))
        .when(x["fy"]["a"].isNotNull(), F.struct(F.lit("fy").alias("k"), x["fy"]["a"].alias("a"), x["fy"]["a"].alias("b")))
        .when(x["span"]["a"].isNotNull(), F.struct(F.lit("span").alias("k"), x["span"]["a"].alias("a"), x["span"]["b"].alias("b")))
        .when(x["year"]["a"].isNotNull(), F.struct(F.lit("year").alias("k"), x["year"]["a"].alias("a"), x["year"]["a"].alias("b"))),
    )

    def numbers(x: Column) -> Column:
        start = F.when(F.length(x["a"]) == 4, _int(x["a"])).otherwise(2000 + _int(x["a"]))
        century = F.when(x["k"].isin("fy_span", "span"), F.floor(start / 100).cast("int") * 100).otherwise(2000)
        end = F.when(F.length(x["b"]) == 4, _int(x["b"])).otherwise(century + _int(x["b"]))
        early = F.when(x["k"] == "span", end <= start).otherwise(end < start)
        return F.struct(x["k"].alias("k"), start.alias("s"), F.when(early, end + 100).otherwise(end).alias("e"))

    def dates(x: Column) -> Column:
        fiscal = x["k"].isin("fy", "fy_span") | ((x["k"] == "span") & (x["e"] - x["s"] == 1))
        from_, to = _year(x["s"], x["e"], fiscal, first_month)
        return F.struct(from_.alias("start"), to.alias("end"), F.when(fiscal, "fiscal_in").otherwise("calendar").alias("basis"), x["k"].alias("k"))

    return let(pick, lambda x: F.when(x.isNotNull(), let(numbers(x), dates)))


def parse_period(label: Column | str, first_month: int = 4) -> Column:
    """struct<start, end, basis, label>. Parts of years rest on the year they name; a day beats a month, a month a year."""
    struct = lambda s, e, b: F.struct(s.cast("date").alias("start"), e.cast("date").alias("end"), b.cast("string").alias("basis"))

    def read(t: Column) -> Column:
        g = lambda name, i: F.regexp_extract(t, PATTERNS[name], i)

        def part(name: str, months: int) -> Column:
            first = (_int(g(name, 1)) - 1) * months
            made = let(_years(g(name, 2), first_month), lambda b: F.when(b["start"].isNotNull(), struct(F.add_months(b["start"], first), F.last_day(F.add_months(b["start"], first + months - 1)), b["basis"])))
            return F.when(t.rlike(PATTERNS[name]), made)

        n = _int(g("months", 1))
        cumulative = F.when(
            t.rlike(PATTERNS["months"]) & n.between(1, 12),
            let(_years(g("months", 2), first_month), lambda b: F.when(b["start"].isNotNull(), struct(b["start"], F.last_day(F.add_months(b["start"], n - 1)), b["basis"]))),
        )
        day = (
            F.when(t.rlike(PATTERNS["iso"]), _day(_int(g("iso", 1)), _int(g("iso", 2)), _int(g("iso", 3))))
            .when(t.rlike(PATTERNS["dmy"]), _day(_int(g("dmy", 3)), _month(g("dmy", 2)), _int(g("dmy", 1))))
            .when(t.rlike(PATTERNS["mdy"]), _day(_int(g("mdy", 3)), _month(g("mdy", 1)), _int(g("mdy", 2))))
        )
        year = F.when(F.length(g("month", 2)) == 4, _int(g("month", 2))).otherwise(2000 + _int(g("month", 2)))
        as_of = t.rlike(r"\bas\s+(?:of|at|on)\b")
        month = F.when(
            t.rlike(PATTERNS["month"]),
            let(F.make_date(year, _month(g("month", 1)), F.lit(1)), lambda f: struct(F.when(as_of, F.last_day(f)).otherwise(f), F.last_day(f), F.when(as_of, "point_in_time").otherwise("calendar"))),
        )

        def settle(x: Column) -> Column:
            whole = x["year"]
            year_ = struct(whole["start"], whole["end"], whole["basis"])
            return F.coalesce(
                F.when(whole["k"].isin("calendar", "fy", "fy_span"), year_),
                F.when(x["day"].isNotNull(), struct(x["day"], x["day"], F.lit("point_in_time"))),
                F.when(whole["k"] == "span", year_),
                month,
                F.when(whole["start"].isNotNull(), year_),
                struct(F.lit(None), F.lit(None), F.lit("unknown")),
            )

        return F.coalesce(part("quarter", 3), part("half", 6), cumulative, let(F.struct(_years(t, first_month).alias("year"), day.alias("day")), settle))

    def result(text: Column) -> Column:
        return let(read(F.lower(text)), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["basis"].alias("basis"), text.alias("label")))

    return let(clean_text(label), result)


def _known(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & _c(c).isNotNull()
    return out


def periods_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.coalesce((s1 <= e2) & (s2 <= e1), F.lit(False)) & _known(s1, e1, s2, e2)


def period_contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The first holds the second and is longer."""
    return F.coalesce((s1 <= s2) & (e2 <= e1) & ((s1 < s2) | (e2 < e1)), F.lit(False))


def periods_equal(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.coalesce((s1 == s2) & e1.eqNullSafe(e2), F.lit(False))
