"""Totals, histograms and the predicate registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.funnel import latest_facts


def totals(**tables: DataFrame) -> DataFrame:
    """``metric, n``: rows of each table given; one count a table, no shuffle of rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def verification(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: facts, verified facts, the rest (facts without evidence included), and the rate to four places."""
    v = latest_facts(facts).select("fact_id", "evidence_id").join(evidence.select("evidence_id", "verified"), "evidence_id", "left")
    n, ok = F.count("*"), F.count_if("verified")
    return v.agg(n.alias("n_facts"), ok.alias("n_verified"), (n - ok).alias("n_quarantined"), F.coalesce(F.round(F.try_divide(ok, n), 4), F.lit(0.0)).alias("verification_rate"))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def daily_growth(facts: DataFrame) -> DataFrame:
    return latest_facts(facts).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def json_sum(column: Column | str, path: str) -> Column:
    """Sum of a number inside JSON notes; what is no number counts as nothing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(F.get_json_object(c, path).try_cast("bigint")), F.lit(0))


def stage_rollup(runs: DataFrame, stage: str, seconds: str, notes: str) -> DataFrame:
    """Seconds, rows and a noted count by stage."""
    return runs.groupBy(F.col(stage).alias("stage")).agg(F.round(F.sum(seconds), 2).alias("seconds"), F.count("*").alias("n_runs"), json_sum(notes, "$.k").alias("noted"))


def collections(documents: DataFrame) -> DataFrame:
    return documents.filter("collection is not null").select("collection").distinct()


def collection_rollup(listing: DataFrame) -> DataFrame:
    """Documents, pages, chunks, facts and verified facts of each collection."""
    return listing.groupBy("collection").agg(F.count("*").alias("n_documents"), *[F.sum(c).cast("bigint").alias(c) for c in ("n_pages", "n_chunks", "n_facts", "n_verified")])


# Registry --------------------------------------------------------------------------------------------------------------


def register_facts(facts: DataFrame) -> DataFrame:
    """Registry entries as facts give them: counts, and the attributes of the predicate's first fact."""
    first = F.min_by(F.struct("value_type", "unit_dimension", "fact_id", "doc_id", "subject_raw", "value_raw"), F.struct("created_at", "fact_id"))
    rows = latest_facts(facts).filter("predicate_canonical is not null").groupBy("predicate_canonical").agg(F.count("*").alias("n_facts"), first.alias("f"))
    about = F.substring(F.concat_ws(" ", F.lit("First seen as"), F.col("f.subject_raw"), F.col("f.value_raw")), 1, 300)
    return rows.select(
        "predicate_canonical", about.alias("description"), F.col("f.value_type").alias("expected_value_type"), F.col("f.unit_dimension").alias("expected_unit_dimension"),
        F.col("f.fact_id").alias("example_fact_id"), F.col("f.doc_id").alias("first_seen_doc_id"), "n_facts",
    )


def recount_predicates(registry: DataFrame, facts: DataFrame) -> DataFrame:
    """The registry with counts over all facts, verified or not; 0 where none is left."""
    n = latest_facts(facts).groupBy("predicate_canonical").agg(F.count("*").alias("_n"))
    return registry.drop("n_facts").join(n, "predicate_canonical", "left").withColumn("n_facts", F.coalesce("_n", F.lit(0))).drop("_n")


def bump_predicates(registry: DataFrame, increments: DataFrame) -> DataFrame:
    """Adds ``predicate_canonical, k`` to the counts; unknown predicates become entries, known ones keep their descriptions."""
    inc = increments.groupBy("predicate_canonical").agg(F.sum("k").alias("_k"))
    return registry.join(inc, "predicate_canonical", "full_outer").withColumn("n_facts", (F.coalesce("n_facts", F.lit(0)) + F.coalesce("_k", F.lit(0))).cast("bigint")).drop("_k")


def top_predicates(registry: DataFrame, n: int = 40) -> DataFrame:
    return registry.orderBy(F.desc("n_facts"), "predicate_canonical").limit(n)


def vocabulary_hint(registry: DataFrame, n: int = 40) -> DataFrame:
    """One row, ``hint``: the most frequent predicates with their expected unit, one a line."""
    line = F.concat(F.lit("- "), "predicate_canonical", F.coalesce(F.concat(F.lit(" ("), "expected_unit_dimension", F.lit(")")), F.lit("")))
    top = top_predicates(registry, n).select(F.struct((-F.col("n_facts")).alias("o"), "predicate_canonical", line.alias("l")).alias("s"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["l"]), "\n").alias("hint"))
