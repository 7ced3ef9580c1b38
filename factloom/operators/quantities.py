"""Quantities recorded in different units and scales, brought to one common unit a dimension.

A multi-pattern automaton finds unit, scale and currency names in the fields of a fact; the longest match wins at each
place, and the fields' context decides between readings of the same word ("m": metres or millions). Names are then joined
with the conversion factors, two constant tables of a few dozen rows, by broadcast.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.tables import COMPOUND_MAGNITUDES, CURRENCY_ALIASES, LETTER_MAGNITUDES, MAGNITUDES, UNITS

_NUMBER = re.compile(r"[-+]?\s?\d[\d,٬]*(?:\.\d+)?|[-+]?\.\d+")
_RANGE = re.compile(r"(\d[\d,]*(?:\.\d+)?)\s*(?:-|to|and)\s*(\d[\d,]*(?:\.\d+)?)")
_NEGATIVE = re.compile(r"^[^\d(]*\(\s*[-+]?[\d.,]+\s*\)")
_DASHES = {c: "-" for c in (*range(0x2010, 0x2016), 0x2212)}

FIELDS = ("value_raw", "unit_raw", "magnitude_label", "unit_canonical", "currency")


def fold(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", text or "").translate(_DASHES).lower().split())


def number_in(text: str) -> float | None:
    """The number of a folded text: digit groups of any size, parentheses as minus, a range as its middle."""
    if (m := _RANGE.search(text)) and not text.startswith(("q", "fy", "h1", "h2")):
        low, high = (float(g.replace(",", "")) for g in m.groups())
        if high > low:
            return (low + high) / 2
    m = _NUMBER.search(text)
    if not m:
        return None
    x = float(re.sub(r"[,٬\s]", "", m.group()))
    return -x if x > 0 and _NEGATIVE.match(text) else x


def automaton():
    """Alias -> list of (kind, name). One alias may have several readings."""
    import ahocorasick

    readings: dict[str, list[tuple[str, str]]] = {}
    for aliases, name, _, _ in UNITS:
        for a in aliases:
            readings.setdefault(a, []).append(("unit", name))
        readings.setdefault(name, [("unit", name)])
    for a in (*MAGNITUDES, *COMPOUND_MAGNITUDES):
        readings.setdefault(a, []).append(("scale", a))
    for a, code in CURRENCY_ALIASES.items():
        readings.setdefault(a, []).append(("currency", code))
    out = ahocorasick.Automaton()
    for a, r in readings.items():
        out.add_word(a, (a, r))
    out.make_automaton()
    return out


def mentions(auto, text: str) -> list[tuple[str, list[tuple[str, str]], bool]]:
    """Longest non-overlapping aliases of ``text``, left to right: (alias, readings, right after a digit)."""
    hits = []
    for end, (alias, readings) in auto.iter(text):
        s, e = end - len(alias) + 1, end + 1
        if alias[0].isalpha() and s and (text[s - 1].isalpha() or text[s - 1] == "_"):
            continue
        if alias[-1].isalpha() and e < len(text) and (text[e].isalpha() or text[e] == "_"):
            continue
        hits.append((s, e, alias, readings))
    hits.sort(key=lambda h: (-(h[1] - h[0]), h[0]))
    taken: list[tuple] = []
    for h in hits:
        if all(h[1] <= t[0] or h[0] >= t[1] for t in taken):
            taken.append(h)
    return [(a, r, bool(re.search(r"\d\s?$", text[:s]))) for s, e, a, r in sorted(taken)]


_DIMENSION = {name: dim for _, name, dim, _ in UNITS}


def read_quantity(auto, fields: tuple[str | None, ...]) -> tuple[float | None, str | None, str | None, str | None]:
    """(number, unit, scale, currency) of ``value_raw, unit_raw, magnitude_label, unit_canonical, currency``.

    The first field that names a unit, a scale or a currency wins, so that one several fields repeat is applied once.
    A lone "m", "b" or "k" is a scale right after a digit or in the label's field, if the other fields name a unit or a
    currency, and "m" is metres otherwise.
    """
    value, unit_raw, label, canonical, currency = (fold(f) for f in fields)
    number = number_in(value)
    found = [mentions(auto, t) for t in (value, unit_raw, label, canonical, currency)]
    unit = scale = money = None
    unsure = []
    for at, hits in enumerate(found):
        for alias, readings, glued in hits:
            if alias in LETTER_MAGNITUDES:
                unsure.append((at, alias, glued))
                continue
            for kind, name in readings:
                if kind == "unit" and unit is None:
                    unit = name
                elif kind == "scale" and scale is None:
                    scale = name
                elif kind == "currency" and money is None:
                    money = name
    for at, alias, glued in unsure:
        known = unit or money
        if at == 2 or (alias != "m" and glued) or (glued and known and _DIMENSION.get(known) != "length"):
            scale = scale or alias
        elif alias == "m" and not known:
            unit = "m"
    if money and not (unit and _DIMENSION[unit] == "ratio"):
        unit = None
    elif unit and _DIMENSION[unit] == "ratio":
        money = scale = None
    return number, unit, scale, money


def factor_tables(spark) -> tuple[DataFrame, DataFrame]:
    """Constant tables: unit -> dimension and factor, scale -> factor."""
    units = spark.createDataFrame([(n, d, f) for _, n, d, f in UNITS], "unit string, dimension string, to_base double")
    scales = spark.createDataFrame([*MAGNITUDES.items(), *COMPOUND_MAGNITUDES.items()], "scale string, factor double")
    return units, scales


def common_quantities(facts: DataFrame, keep: tuple[str, ...] = ("fact_id",)) -> DataFrame:
    """Each fact's quantity: ``keep``..., ``unit, scale, currency_code, dimension, quantity``.

    ``quantity`` is in the dimension's base unit (percent, kg, count, square metre, metre, day, or the currency itself); it
    is null where no number is found. A fact that names no unit has a null dimension. Missing fields count as empty; rows
    are independent, nothing is shuffled. Ratios take no scale.
    """
    spark = facts.sparkSession
    columns = [F.col(c).cast("string").alias(f"_{c}") if c in facts.columns else F.lit(None).cast("string").alias(f"_{c}") for c in FIELDS]
    rows = facts.select(*keep, *columns)
    kept = ", ".join(f"`{c}` {facts.schema[c].dataType.simpleString()}" for c in keep)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in batches:
            got = [read_quantity(auto, f) for f in zip(*(b.column(f"_{c}").to_pylist() for c in FIELDS))]
            cols = list(zip(*got)) if got else [[], [], [], []]
            types = (pa.float64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(cols, types)], names=[*keep, "number", "unit", "scale", "currency_code"])

    parsed = rows.mapInArrow(parse, f"{kept}, number double, unit string, scale string, currency_code string")
    units, scales = factor_tables(spark)
    out = parsed.join(F.broadcast(units), "unit", "left").join(F.broadcast(scales), "scale", "left")
    return out.select(
        *keep,
        "unit",
        "scale",
        "currency_code",
        F.when(F.col("currency_code").isNotNull(), F.lit("currency")).otherwise(F.col("dimension")).alias("dimension"),
        (F.col("number") * F.coalesce("factor", F.lit(1.0)) * F.coalesce("to_base", F.lit(1.0))).alias("quantity"),
    )


def agreeing_pairs(rows: DataFrame, id_col: str, group_col: str, value_col: str, tolerance: float = 0.005) -> DataFrame:
    """Pairs ``(id_a, id_b)`` of one group whose values differ by at most ``tolerance`` of the larger in absolute value.

    A band join: values fall into bins of the tolerance's width on a log scale, and a pair that agrees is in equal or
    neighbouring bins, so a group with a third of all rows is spread over its values. Facts that agree to within a bin are
    pairs, all of them: that is the result asked for, and only it grows with their square. Null
    values and groups agree with nothing; zero agrees with zero only.
    """
    v = F.col("v")
    rel: Column = F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(v)) / math.log1p(tolerance / (1 - tolerance))))
    left = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(value_col).alias("v")).filter(F.col("g").isNotNull() & v.isNotNull() & ~F.isnan(v)).distinct()
    left = left.withColumn("s", F.signum("v").cast("int")).withColumn("bin", rel.cast("bigint"))
    right = left.withColumn("bin", F.explode(F.when(v == 0, F.array(F.col("bin"))).otherwise(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))))
    a, b = left.alias("a"), right.alias("b")
    near = F.abs(F.col("a.v") - F.col("b.v")) <= F.greatest(F.abs("a.v"), F.abs("b.v")) * tolerance
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.id") < F.col("b.id")) & near)
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
