"""Text functions: Column -> Column, all built in, so that they stay inside code generation.

Compatibility forms (full width letters, ligatures) are left alone unless ``exact`` is asked for, which goes through an
Arrow UDF, as Spark has no Unicode normalisation of its own.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTES = "\u2018\u2019"
_DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
_SPACES = "\u00a0\u2007\u202f"

#: Letters with marks of the Latin blocks, and the plain letters they decompose to.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFKD", c)[0] < "\x80" and len(unicodedata.normalize("NFKD", c)) > 1)
FOLDED = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)


def _nfkc(x: Column) -> Column:
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return nfkc(x)


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x: Column | str, exact: bool = False) -> Column:
    """Quotes, dashes and spaces to their plain forms, white space collapsed and trimmed; null becomes empty."""
    text = F.coalesce(_c(x), F.lit(""))
    if exact:
        text = _nfkc(text)
    plain = F.translate(text, _QUOTES + _DASHES + _SPACES, "''" + "-" * len(_DASHES) + " " * len(_SPACES))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def fold_accents(x: Column | str) -> Column:
    """Letters with marks to plain ones; loose combining marks are dropped."""
    return F.regexp_replace(F.translate(_c(x), ACCENTED, FOLDED), r"\p{Mn}+", "")


def snake_case(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(clean_text(x))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def alnum_count(x: Column | str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[^\p{L}\p{N}]", ""))


def strip_markdown(x: Column | str) -> Column:
    """Emphasis marks, heading hashes and table captions removed, pipes to spaces."""
    text = F.regexp_replace(_c(x), r"(?m)\*\*|__|~~|^#+\s*|\[table \d+\]", "")
    return F.trim(F.translate(text, "|", " "))


def normalize_for_hash(x: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(x), r"\s+", " ")))


def canonical_predicate(x: Column | str) -> Column:
    """Snake case without a leading article and one trailing preposition."""
    return F.regexp_replace(F.regexp_replace(snake_case(x), "^(the|a|an)_", ""), "_(of|for|in|at|on|the)$", "")


def canonical_text(markdown: Column | str, plain: Column | str, tables: Column | str | None = None, least: float = 0.95) -> tuple[Column, Column]:
    """(text, source): the markdown if it keeps enough of the plain text's letters and digits, else plain text and tables."""
    n = alnum_count(plain)
    kept = F.when(n == 0, F.lit(1.0)).otherwise(alnum_count(markdown) / n)
    extra = F.coalesce(_c(tables), F.lit("")) if tables is not None else F.lit("")
    joined = F.when(extra == "", F.coalesce(_c(plain), F.lit(""))).otherwise(F.concat_ws("\n\n", _c(plain), extra))
    use = (kept >= least) & _c(markdown).isNotNull()
    return F.when(use, _c(markdown)).otherwise(joined), F.when(use, "markdown").otherwise("plain+tables")


# Ids ------------------------------------------------------------------------------------------------------------------


def digest(*parts: Column | str, length: int = 64) -> Column:
    """First ``length`` hex digits of the SHA-256 of the parts with a zero character between them."""
    zero = F.lit("\0")
    joined = [F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]
    cells = [c for p in joined for c in (zero, p)][1:]
    return F.substring(F.sha2(F.concat(*cells), 256), 1, length)


def content_hash(*parts: Column | str) -> Column:
    """Each part is followed by a zero character."""
    return F.sha2(F.concat(*[c for p in parts for c in (F.coalesce(_c(p).cast("string"), F.lit("")), F.lit("\0"))]), 256)


def text_hash(x: Column | str) -> Column:
    """Key of a text in the vector cache."""
    return F.sha2(_c(x), 256)


def tolerant_date(x: Column | str) -> Column:
    """The ISO date that a text begins with; null for anything else."""
    return F.try_to_date(F.substring(_c(x).cast("string"), 1, 10), "yyyy-MM-dd")


def decode_json(x: Column | str, schema: str, default: Column) -> Column:
    """A JSON text as ``schema``; ``default`` where it is null, empty or no such JSON."""
    return F.coalesce(F.from_json(F.nullif(_c(x), F.lit("")), schema), default)


def chunk_id(doc_id: Column | str, text: Column | str) -> Column:
    return digest(doc_id, normalize_for_hash(text), length=32)


def entity_key(name: Column | str, kind: Column | str) -> Column:
    return digest(kind, name, length=24)


def link_id(a: Column | str, b: Column | str, version: str = "rules-1") -> Column:
    return digest(F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)), F.lit(version), length=32)


def cache_key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[_c(p).cast("string") for p in parts])


def canonical_string(subject, predicate, period, scope) -> Column:
    """What a fact is about, without its value: the text that is embedded."""
    tags = F.array_join(F.array_sort(F.coalesce(_c(scope), F.array().cast("array<string>"))), ",")
    return F.concat_ws(" | ", *[F.coalesce(_c(x), F.lit("")) for x in (subject, predicate, period)], tags)
