"""Subjects, addresses and scope tags: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.number import quote
from factloom.functions.tables import LEGAL_SUFFIXES, SCOPE_ALIASES, SCOPE_SHIFT_GROUPS
from factloom.functions.text import _c, clean_text, fold_accents, let, snake_case

#: Short forms in addresses.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "ln": "lane", "hwy": "highway", "opp": "opposite",
    "bldg": "building", "flr": "floor", "fl": "floor", "apt": "apartment", "ste": "suite", "no": "number", "nr": "near",
    "ind": "industrial", "estt": "estate", "pkwy": "parkway", "sec": "sector", "ph": "phase", "dist": "district",
    "extn": "extension", "ext": "extension", "mkt": "market", "twp": "township", "n": "north", "s": "south", "e": "east", "w": "west",
}
#: Postal codes, forms of address, words of addresses.
POSTAL = r"(?i)\b(\d{6}|\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"
HONORIFICS = ("mr", "mrs", "ms", "dr", "prof", "shri", "smt", "sh")
ADDRESS_HINTS = (
    r"(?i)\b(road|street|lane|avenue|marg|nagar|sector|phase|block|plot|floor|building|tower|"
    r"complex|estate|village|district|po box|p\.o\.|opposite|near)\b"
)


def canonical_subject(x: Column | str) -> Column:
    """Lower case without accents, parentheses, quotes and legal forms (taken off once each, in the list's order)."""
    t = F.lower(fold_accents(clean_text(x)))
    t = F.regexp_replace(t, "[\"'`]", "")
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    t = F.regexp_replace(t, "[^a-z0-9&/ .-]+", " ")
    for form in LEGAL_SUFFIXES:
        t = F.regexp_replace(t, rf"(?:,|\s)\s*{quote(form)}\.?\s*$", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"^the\s+", ""), r"[.\-]+$", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_address(x: Column | str) -> Column:
    """struct<normalized, postal_code, tokens>: upper case, short forms written out, the postal code apart."""
    table = F.create_map(*[F.lit(v.upper()) for kv in ADDRESS_WORDS.items() for v in kv])

    def split(t: Column) -> Column:
        return let(F.regexp_extract(t, POSTAL, 1), lambda raw: F.struct(raw.alias("raw"), F.when(raw == "", t).otherwise(F.replace(t, raw, F.lit(" "))).alias("rest")))

    def words(p: Column) -> Column:
        plain = F.filter(F.split(F.regexp_replace(p["rest"], "[^A-Z0-9 ]+", " "), " +"), lambda w: w != "")
        return F.struct(F.nullif(F.regexp_replace(p["raw"], r"\s+", ""), F.lit("")).alias("postal_code"), F.transform(plain, lambda w: F.coalesce(F.try_element_at(table, w), w)).alias("tokens"))

    return let(let(let(F.upper(clean_text(x)), split), words), lambda r: F.struct(F.array_join(r["tokens"], " ").alias("normalized"), r["postal_code"].alias("postal_code"), r["tokens"].alias("tokens")))


def guess_entity_type(x: Column | str) -> Column:
    """address, organisation, person, person_or_organisation (two to four capitalised words) or concept."""
    legal = r"(?:^|\W)(?:" + "|".join(quote(s) for s in LEGAL_SUFFIXES) + r")\.?(?:$|\W)"

    def guess(t: Column) -> Column:
        words = F.split(t, " ")
        capital = F.forall(words, lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
        return (
            F.when((F.regexp_extract(t, POSTAL, 1) != "") | t.rlike(ADDRESS_HINTS), "address")
            .when(F.lower(t).rlike(legal), "organisation")
            .when(F.lower(t).rlike("^(?:" + "|".join(HONORIFICS) + r")\.? "), "person")
            .when(F.size(words).between(2, 4) & capital & ~t.rlike(r"\d"), "person_or_organisation")
            .otherwise("concept")
        )

    return let(clean_text(x), guess)


def types_compatible(a: Column, b: Column) -> Column:
    vague = ("unknown", "concept", "person_or_organisation")
    return (a == b) | a.isin(*vague) | b.isin(*vague)


def normalize_scope_tags(tags: Column | str) -> Column:
    """Sorted distinct tags in the shared vocabulary; unknown ones in snake case."""
    table = F.create_map(*[F.lit(v) for kv in SCOPE_ALIASES.items() for v in kv])

    def one(tag: Column) -> Column:
        bare = F.regexp_replace(F.lower(clean_text(tag)), "^[ .,]+|[ .,]+$", "")
        spaced = F.translate(bare, "_", " ")
        return F.when(bare == "", F.lit("")).otherwise(F.coalesce(F.try_element_at(table, bare), F.try_element_at(table, spaced), snake_case(bare)))

    given = F.coalesce(_c(tags), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(given, one), lambda x: x != "")))


def scope_shift(a: Column, b: Column) -> Column:
    """Reasons why two tag sets speak of different scopes; an empty array if they don't."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    diff = F.array_union(F.array_except(a, b), F.array_except(b, a))
    reasons = []
    for group in SCOPE_SHIFT_GROUPS:
        g = F.array(*[F.lit(x) for x in group])
        in_a, in_b, odd = (F.array_sort(F.array_intersect(x, g)) for x in (a, b, diff))
        both = (F.size(in_a) > 0) & (F.size(in_b) > 0)
        reasons.append(
            F.when(both & (in_a != in_b), F.concat(F.try_element_at(in_a, F.lit(1)), F.lit(" versus "), F.try_element_at(in_b, F.lit(1)))).when(
                ~both & (F.size(odd) > 0), F.concat(F.try_element_at(odd, F.lit(1)), F.lit(" present on one side only"))
            )
        )
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
