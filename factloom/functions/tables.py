"""Fixed values that results depend on: word lists and factors, in natural order."""

from __future__ import annotations

# Scales -----------------------------------------------------------------------------------------------------------
MAGNITUDES = {
    "hundred": 1e2,
    "k": 1e3, "'000": 1e3, "000s": 1e3, "thousand": 1e3, "thousands": 1e3,
    "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "mn": 1e6, "m": 1e6, "million": 1e6, "millions": 1e6,
    "cr": 1e7, "crore": 1e7, "crores": 1e7, "cr.": 1e7,
    "bn": 1e9, "b": 1e9, "billion": 1e9, "billions": 1e9,
    "tn": 1e12, "trillion": 1e12, "trillions": 1e12,
}
COMPOUND_MAGNITUDES = {"lakh crore": 1e12, "lakh crores": 1e12, "thousand crore": 1e10, "thousand crores": 1e10}
#: Single letters count only right after a digit.
LETTER_MAGNITUDES = ("m", "b", "k")

# Currencies, in order of precedence ---------------------------------------------------------------------------------
CURRENCY_PATTERNS = (
    ("₹", "INR"),
    (r"\brs\.?\b", "INR"),
    (r"\binr\b", "INR"),
    (r"\brupees?\b", "INR"),
    (r"\bus\s*\$", "USD"),
    (r"\busd\b", "USD"),
    (r"\bus\s*dollars?\b", "USD"),
    (r"\$", "USD"),
    ("€", "EUR"),
    (r"\beur\b", "EUR"),
    ("£", "GBP"),
    (r"\bgbp\b", "GBP"),
    ("¥", "JPY"),
    (r"\bjpy\b", "JPY"),
)
#: The same as plain words for a word automaton.
CURRENCY_ALIASES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR",
    "us$": "USD", "us $": "USD", "usd": "USD", "us dollar": "USD", "us dollars": "USD", "$": "USD",
    "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "¥": "JPY", "jpy": "JPY",
}

# Units: aliases, canonical name, dimension, factor to the dimension's base -------------------------------------------
UNITS = (
    (("%", "percent", "per cent", "pct", "percentage", "percentage points", "ppt"), "percent", "ratio", 1.0),
    (("bps", "bp", "basis points", "basis point"), "bps", "ratio", 0.01),
    (("x", "times"), "times", "ratio_multiple", 1.0),
    (("tonne", "tonnes", "ton", "tons", "mt", "metric ton", "metric tonnes", "metric tonne"), "tonne", "mass", 1000.0),
    (("kg", "kgs", "kilogram", "kilograms"), "kg", "mass", 1.0),
    (("g", "gram", "grams"), "g", "mass", 0.001),
    (("shipments", "shipment", "parcels", "parcel", "units", "unit", "count", "nos", "no.", "number"), "count", "count", 1.0),
    (("people", "persons", "employees", "headcount", "staff"), "people", "count", 1.0),
    (("customers", "clients"), "customers", "count", 1.0),
    (("orders", "order"), "orders", "count", 1.0),
    (("stores", "facilities", "centres", "centers", "hubs", "gateways"), "facilities", "count", 1.0),
    (("sq ft", "sq. ft.", "sqft", "square feet", "square foot", "sq.ft"), "sq_ft", "area", 0.09290304),
    (("sq m", "sqm", "square metres", "square meters", "sq. m."), "sq_m", "area", 1.0),
    (("acre", "acres"), "acre", "area", 4046.8564224),
    (("km", "kilometre", "kilometres", "kilometer", "kilometers"), "km", "length", 1000.0),
    (("m", "metre", "metres", "meter", "meters"), "m", "length", 1.0),
    (("day", "days"), "day", "duration", 1.0),
    (("week", "weeks"), "week", "duration", 7.0),
    (("month", "months"), "month", "duration", 30.436875),
    (("year", "years", "yrs"), "year", "duration", 365.2425),
    (("hour", "hours", "hrs", "hr"), "hour", "duration", 1 / 24),
    (("minute", "minutes", "mins"), "minute", "duration", 1 / 1440),
)

# Words that bound a number -------------------------------------------------------------------------------------------
BOUND_PATTERNS = (
    (r"(?:^|\s)(?:~|approx\.?|approximately|about|around|roughly|nearly|almost|circa|c\.)\s*", "approximate"),
    (r"(?:^|\s)(?:over|more than|greater than|above|at least|in excess of|\+|>=|>)\s*", "lower_bound"),
    (r"(?:^|\s)(?:under|less than|below|up to|at most|fewer than|<=|<)\s*", "upper_bound"),
)

# Scope tags ----------------------------------------------------------------------------------------------------------
SCOPE_ALIASES = {
    "consol": "consolidated", "consolidated": "consolidated", "group": "consolidated",
    "standalone": "standalone", "stand alone": "standalone", "separate": "standalone",
    "proforma": "pro_forma", "pro forma": "pro_forma", "pro-forma": "pro_forma",
    "adj": "adjusted", "adj.": "adjusted", "adjusted": "adjusted",
    "reported": "reported", "actual": "reported", "actuals": "reported",
    "provisional": "provisional", "prov": "provisional",
    "revised": "revised", "re": "revised", "first revised": "revised", "second revised": "revised",
    "estimate": "estimate", "estimated": "estimate", "advance estimate": "estimate", "ae": "estimate",
    "projection": "forecast", "projected": "forecast", "forecast": "forecast", "budgeted": "forecast", "be": "forecast",
    "segment": "segment", "total": "total",
    "since inception": "since_inception", "cumulative": "since_inception",
    "excluding traded goods": "excluding_traded_goods", "ex traded goods": "excluding_traded_goods",
    "yoy": "year_on_year", "qoq": "quarter_on_quarter",
    "seasonally adjusted": "seasonally_adjusted",
    "annualised": "annualised", "annualized": "annualised",
    "per cent of gdp": "percent_of_gdp", "percent of gdp": "percent_of_gdp",
}
SCOPE_SHIFT_GROUPS = (
    ("adjusted", "reported"),
    ("standalone", "consolidated"),
    ("pro_forma", "reported"),
    ("estimate", "provisional", "revised", "reported", "forecast"),
    ("segment", "total"),
    ("since_inception", "total"),
    ("excluding_traded_goods", "total"),
    ("seasonally_adjusted", "reported"),
    ("annualised", "reported"),
)

# Legal forms, removed in this order ----------------------------------------------------------------------------------
LEGAL_SUFFIXES = (
    "private limited", "public limited company", "limited liability partnership", "limited", "ltd", "pvt", "plc", "llp",
    "incorporated", "inc", "corporation", "corp", "company", "co", "gmbh", "s.a.", "n.v.",
)
