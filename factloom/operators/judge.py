"""Pairs that no rule settles, put to an outside judge: prompt, budget, verdict. The judge itself is a hook over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Takes ``link_id, prompt``, gives ``link_id, relation, confidence, explanation``; a row without a relation is a failed call.
Hook = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ANSWER = "link_id string, relation string, confidence double, explanation string"
#: A fact's fields that the judge sees, pairs a document may put to it.
SHOWN = ("subject_raw", "predicate_canonical", "value_raw", "value_num", "unit_canonical", "currency", "period_label_raw", "scope_tags", "qualifiers")
BUDGET = 75


def rendered_trace(trace: Column | str) -> Column:
    """The checks as numbered lines, each with its inputs below."""
    t = F.col(trace) if isinstance(trace, str) else trace
    lines = F.transform(t, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["name"], F.lit(": "), F.coalesce(c["outcome"], F.lit("")), F.lit("\n   inputs: "), F.to_json(c["inputs"])))
    return F.when(F.size(t) > 0, F.array_join(lines, "\n")).otherwise("(no checks recorded)")


def prompt(a: str, b: str, trace: Column | str, instructions: str) -> Column:
    """Instructions, both facts with their source and quote, and what the rules found. ``a`` and ``b`` are struct columns."""

    def side(s: str, name: str) -> Column:
        f = F.col(s)
        source = F.concat_ws(", ", F.coalesce(f["document_title"], f["filename"], F.lit("unknown")), F.concat(F.lit("as of "), F.coalesce(f["as_of_date"].cast("string"), F.lit("unstated"))), F.concat(F.lit("page "), f["page_index"].cast("string")))
        return F.concat_ws("\n", F.concat(F.lit(f"{name}: "), source), F.to_json(F.struct(*[f[c].alias(c) for c in SHOWN])), F.concat(F.lit('quote: "'), F.trim(F.coalesce(f["quote"], F.lit(""))), F.lit('"')))

    return F.concat_ws("\n\n", F.lit(instructions), side(a, "A"), side(b, "B"), F.concat(F.lit("Checks:\n"), rendered_trace(trace)))


def judge_residue(residue: DataFrame, view: DataFrame, hook: Hook, model: str, version: str, instructions: str = "How do these two facts relate?") -> DataFrame:
    """The undecided pairs with the judge's verdict: relation, confidence, explanation, ``decided_by = 'judge'``, and one more check.

    ``residue`` has ``link_id, fact_a, fact_b, trace`` and is within its budget (``funnel.residue_budget``); ``view`` is the facts'
    view with documents and evidence. Pairs whose facts are gone and those the judge fails on are dropped, to be tried again.
    """
    facts = view.select("fact_id", F.struct(*SHOWN, "document_title", "filename", "as_of_date", "page_index", "quote").alias("f"))
    both = residue.join(facts.withColumnsRenamed({"fact_id": "fact_a", "f": "_a"}), "fact_a").join(facts.withColumnsRenamed({"fact_id": "fact_b", "f": "_b"}), "fact_b")
    asked = both.select("link_id", prompt("_a", "_b", "trace", instructions).alias("prompt"))
    answers = asked.mapInArrow(hook, ANSWER).filter("relation is not null").dropDuplicates(["link_id"])
    inputs = F.map_from_arrays(F.array(F.lit("model"), F.lit("version")), F.array(F.lit(model), F.lit(version)))
    step = F.struct(F.lit("judge").alias("name"), inputs.alias("inputs"), F.col("relation").alias("outcome"))
    rows = residue.drop("relation", "confidence", "explanation", "decided_by").join(answers, "link_id")
    return rows.withColumns({"trace": F.array_append("trace", step), "explanation": F.trim("explanation"), "decided_by": F.lit("judge")})
