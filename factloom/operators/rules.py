"""Classification of fact pairs: an ordered chain of checks, the first that settles a pair wins, each leaves a trace."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.fuzzy import token_set, token_sort
from factloom.functions.number import precision, relative_delta, tolerance, unit_factor
from factloom.functions.period import period_contains, periods_equal, periods_overlap
from factloom.functions.subject import normalize_address, scope_shift
from factloom.functions.text import clean_text, link_id

#: Parts of qualifier names that state an exchange rate.
RATE_KEYS = ("exchange_rate", "fx_rate", "conversion_rate", "usd_inr", "rate_used")
FACT_COLUMNS = (
    "fact_id", "doc_id", "entity_id", "predicate", "predicate_canonical", "value_raw", "value_type", "value_num", "value_text", "unit_canonical",
    "unit_dimension", "currency", "period_start", "period_end", "period_label_raw", "scope_tags", "qualifiers",
)


def pair_facts(pairs: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Both sides' columns beside each pair, as structs ``a`` and ``b``; the wide columns are fetched only now.

    What depends on one fact alone (its number's precision, its address) is worked out before pairing, once a fact.
    """
    docs = documents.select("doc_id", "as_of_date").dropDuplicates(["doc_id"])
    words = clean_text(F.coalesce(F.nullif("value_text", F.lit("")), "value_raw"))
    once = {"precision": precision("value_raw"), "words": words, "address": normalize_address(words), "factor": unit_factor("unit_canonical"), "stated_rate": _stated_rate(F.col("qualifiers"))}
    wide = facts.select(*FACT_COLUMNS).withColumns(once).join(docs, "doc_id", "left").select(F.col("fact_id"), F.struct(*FACT_COLUMNS, *once, "as_of_date").alias("f"))
    a, b = wide.withColumnsRenamed({"fact_id": "fact_a", "f": "a"}), wide.withColumnsRenamed({"fact_id": "fact_b", "f": "b"})
    return pairs.join(a, "fact_a").join(b, "fact_b")


def _stated_rate(q: Column) -> Column:
    return F.coalesce(F.exists(F.map_keys(q), lambda k: F.lower(k).rlike("|".join(RATE_KEYS))), F.lit(False))


def _check(name: str, outcome: Column, **inputs: Column) -> Column:
    cells = F.map_from_arrays(F.array(*[F.lit(k) for k in inputs]), F.array(*[v.cast("string") for v in inputs.values()])) if inputs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(F.lit(name).alias("name"), cells.alias("inputs"), outcome.cast("string").alias("outcome"))


def evaluate_pairs(paired: DataFrame, floor: float = 0.005, minor: float = 0.02) -> DataFrame:
    """``fact_a, fact_b, relation, confidence, step, explanation, numeric_delta, relative_delta, trace, link_id``.

    ``paired`` has structs ``a`` and ``b``. ``relation`` is null for pairs that no rule settles. The relative tolerance is the
    looser of ``floor`` and the precision either side writes; below ``minor`` a gap still corroborates, less surely.
    """
    a, b = (lambda c: F.col("a")[c]), (lambda c: F.col("b")[c])
    differ = lambda c: F.coalesce(a(c) != b(c), F.lit(False))
    wordy = ~F.coalesce((a("value_type") == "numeric") & (b("value_type") == "numeric"), F.lit(False))
    postal = a("address")["postal_code"]
    p = paired.withColumns({
        "_sort": token_sort(F.when(wordy, F.lower(a("words"))), F.when(wordy, F.lower(b("words")))),
        "_set": token_set(F.when(wordy & postal.isNotNull(), a("address")["normalized"]), F.when(wordy, b("address")["normalized"])),
        "_pa": F.coalesce(a("predicate_canonical"), a("predicate")),
        "_pb": F.coalesce(b("predicate_canonical"), b("predicate")),
        "_converts": F.coalesce(a("unit_canonical") != b("unit_canonical"), F.lit(False)),
        "_same_dim": F.coalesce(a("unit_dimension") == b("unit_dimension"), F.lit(False)),
    })
    p = p.withColumn("_vb", F.when(F.col("_converts"), b("value_num") * b("factor") / a("factor")).otherwise(b("value_num")))
    p = p.withColumns({
        "_delta": F.col("_vb") - a("value_num"),
        "_rel": relative_delta(a("value_num"), F.col("_vb")),
        "_tol": tolerance(a("precision"), b("precision"), a("value_num"), F.col("_vb"), floor),
        "_shift": scope_shift(a("scope_tags"), b("scope_tags")),
    })
    days = (a("period_start"), a("period_end"), b("period_start"), b("period_end"))
    dated = a("period_start").isNotNull() & b("period_start").isNotNull()
    p = p.withColumns({
        "_agrees": F.coalesce(F.col("_rel") <= F.col("_tol"), F.lit(False)),
        "_period": F.when(~dated, "unknown_on_one_side").when(periods_equal(*days), "equal").when(period_contains(*days) | period_contains(*days[2:], *days[:2]), "nested").when(~periods_overlap(*days), "disjoint").otherwise("overlapping_not_equal"),
        "_shifted": F.size("_shift") > 0,
    })
    agrees, period, shifted, rel = F.col("_agrees"), F.col("_period"), F.col("_shifted"), F.col("_rel")
    one_dim = a("unit_dimension").isNotNull() & b("unit_dimension").isNotNull()
    rate = a("stated_rate") | b("stated_rate")
    same_claim = a("predicate_canonical").eqNullSafe(b("predicate_canonical")) & a("entity_id").eqNullSafe(b("entity_id")) & (period == "equal")
    none = F.lit(None).cast("string")
    # (step, condition, relation, confidence), in order
    chain = [
        ("value_type", ~a("value_type").eqNullSafe(b("value_type")), F.lit("unrelated"), 0.95),
        ("unit_dimension", differ("unit_dimension"), F.lit("unrelated"), 0.95),
        ("predicate_without_dimension", ~F.col("_pa").eqNullSafe(F.col("_pb")) & ~one_dim, F.lit("unrelated"), 0.9),
        ("currency", differ("currency") & ~rate, F.lit("unrelated"), 0.9),
        ("currency_with_rate", differ("currency"), none, 0.5),
        ("address", wordy & F.coalesce((postal == b("address")["postal_code"]) & (F.col("_set") >= 80), F.lit(False)), F.lit("corroborates"), 0.9),
        ("wording", wordy & (F.col("_sort") >= 95), F.lit("corroborates"), 0.85),
        ("wording_period", wordy & (period == "disjoint"), F.lit("reconciled_by_period"), 0.8),
        ("wording_scope", wordy & shifted, F.lit("reconciled_by_scope"), 0.75),
        ("wording_unsettled", wordy, none, 0.5),
        ("numeric_values", a("value_num").isNull() | b("value_num").isNull(), none, 0.4),
        ("unit_conversion", F.col("_converts") & ~F.col("_same_dim"), F.lit("unrelated"), 0.9),
        ("unit_agreement", F.col("_converts") & agrees, F.lit("reconciled_by_unit"), 0.9),
        ("period_nested", period == "nested", F.lit("refines"), 0.9),
        ("period_disjoint", period == "disjoint", F.lit("reconciled_by_period"), 0.92),
        ("scope", shifted & ~agrees, F.lit("reconciled_by_scope"), 0.85),
        ("vintage", same_claim & differ("as_of_date") & ~agrees, F.lit("reconciled_by_vintage"), 0.85),
        ("agreement", agrees, F.lit("corroborates"), 0.9),
        ("minor_gap", rel < minor, F.lit("corroborates"), 0.6),
        ("material_gap", F.lit(True), none, 0.5),
    ]
    verdict = None
    for step, cond, relation, confidence in reversed(chain):
        row = F.struct(F.lit(step).alias("step"), relation.cast("string").alias("relation"), F.lit(confidence).alias("confidence"))
        verdict = row if verdict is None else F.when(F.coalesce(cond, F.lit(False)), row).otherwise(verdict)
    p = p.withColumn("_v", verdict)
    compared = ~wordy & a("value_num").isNotNull() & b("value_num").isNotNull() & (F.col("_v.step") != "unit_conversion") & ~F.col("_v.step").isin("value_type", "unit_dimension", "predicate_without_dimension", "currency", "currency_with_rate")
    trace = F.array_compact(F.array(
        _check("value_type", F.when(a("value_type").eqNullSafe(b("value_type")), "same").otherwise("different"), a=a("value_type"), b=b("value_type")),
        _check("unit_dimension", F.when(differ("unit_dimension"), "different").otherwise("compatible"), a=a("unit_dimension"), b=b("unit_dimension")),
        _check("currency", F.when(differ("currency"), "different").otherwise("same"), a=a("currency"), b=b("currency")),
        F.when(compared, _check("numeric_comparison", F.when(agrees, "agrees_within_tolerance").otherwise("differs"), a=a("value_num"), b=F.col("_vb"), relative_delta=F.round("_rel", 6), tolerance=F.round("_tol", 6))),
        F.when(compared, _check("period_comparison", period, a=a("period_label_raw"), b=b("period_label_raw"))),
        F.when(compared, _check("scope_comparison", F.when(shifted, "scope_shift").otherwise("comparable"), reasons=F.array_join("_shift", "; "))),
        _check("verdict", F.coalesce(F.col("_v.relation"), F.lit("undecided")), step=F.col("_v.step")),
    ))
    return p.select(
        "fact_a", "fact_b", F.col("_v.relation").alias("relation"), F.col("_v.confidence").alias("confidence"), F.col("_v.step").alias("step"), _explanation().alias("explanation"),
        F.when(compared, F.col("_delta")).alias("numeric_delta"), F.when(compared, rel).alias("relative_delta"), trace.alias("trace"), link_id("fact_a", "fact_b").alias("link_id"),
    )


#: What each step says of a pair, for readers of the links.
EXPLANATIONS = {
    "value_type": "One value is {a.value_type}, the other {b.value_type}.",
    "unit_dimension": "The units measure different things: {a.unit_dimension} and {b.unit_dimension}.",
    "predicate_without_dimension": "Different predicates, and no common dimension to compare them by.",
    "currency": "Stated in {a.currency} and {b.currency}, without a rate of exchange.",
    "currency_with_rate": "Stated in {a.currency} and {b.currency}, with a rate of exchange: to be judged.",
    "address": "Two spellings of one address, with the same postal code.",
    "wording": "The same wording, apart from order and spelling.",
    "wording_period": "Different texts of different periods: {a.period_label_raw} and {b.period_label_raw}.",
    "wording_scope": "Different texts of different scopes: {shift}.",
    "wording_unsettled": "Different texts that nothing explains.",
    "numeric_values": "A number is missing on one side.",
    "unit_conversion": "{a.unit_canonical} can't be converted to {b.unit_canonical}.",
    "unit_agreement": "The same value in {a.unit_canonical} and {b.unit_canonical}.",
    "period_nested": "One period lies within the other: {a.period_label_raw} and {b.period_label_raw}.",
    "period_disjoint": "Different periods: {a.period_label_raw} and {b.period_label_raw}.",
    "scope": "Different scopes: {shift}.",
    "vintage": "One claim from documents of different dates: {a.as_of_date} and {b.as_of_date}.",
    "agreement": "The values agree within the precision written, {gap} apart.",
    "minor_gap": "The values are {gap} apart, more than rounding but little.",
    "material_gap": "The values are {gap} apart, and neither unit, period, scope nor date explains it.",
}


def _explanation() -> Column:
    """The verdict's step in words, with both sides' values put in."""
    put = {"shift": F.array_join("_shift", "; "), "gap": F.concat(F.format_string("%.2f", F.col("_rel") * 100), F.lit("%"))}
    out = F.lit(None).cast("string")
    for step, text in EXPLANATIONS.items():
        cells = [put[x] if x in put else F.col(x).cast("string") if x[:2] in ("a.", "b.") else F.lit(x) for x in re.split(r"[{}]", text) if x]
        out = F.when(F.col("_v.step") == step, F.concat(*[F.coalesce(c, F.lit("unstated")) for c in cells])).otherwise(out)
    return out


def storable_links(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links to keep, undecided pairs): pairs found unrelated are counted elsewhere and never stored."""
    return decided.filter("relation is not null and relation <> 'unrelated'"), decided.filter("relation is null")
