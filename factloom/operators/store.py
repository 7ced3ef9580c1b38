"""Writes: upsert by key, replacement by document, cascading delete, caches. Each is a DataFrame of the table's new content."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(base: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with the same key; columns that ``new`` lacks become null."""
    rows = last_wins(new, key, order) if order else new.dropDuplicates(key)
    return base.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_by_document(base: DataFrame, new: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All rows of the documents concerned are replaced, also by none."""
    docs = (documents if documents is not None else new).select("doc_id").distinct()
    return base.join(docs, "doc_id", "left_anti").unionByName(new)


def delete_document_facts(docs: DataFrame, facts: DataFrame, evidence: DataFrame, embeddings: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table when the documents' facts go, with the links on either side, vectors and evidence."""
    gone = facts.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("fact_id").distinct()
    a, b = gone.withColumnRenamed("fact_id", "fact_a"), gone.withColumnRenamed("fact_id", "fact_b")
    return {
        "links": links.join(a, "fact_a", "left_anti").join(b, "fact_b", "left_anti"),
        "embeddings": embeddings.join(gone, "fact_id", "left_anti"),
        "evidence": evidence.join(gone, "fact_id", "left_anti"),
        "facts": facts.join(docs.select("doc_id").distinct(), "doc_id", "left_anti"),
    }


def set_values(df: DataFrame, key: str, changes: DataFrame, nulls: bool = False) -> DataFrame:
    """Updates by key: each column of ``changes`` replaces the table's where the key is given and, unless ``nulls``, the value isn't null."""
    fields = [c for c in changes.columns if c != key]
    new = changes.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    new = new.withColumn("_given", F.lit(True))
    value = lambda c: F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"_{c}", c)
    return df.join(new, key, "left").select(*[value(c).alias(c) if c in fields else F.col(c) for c in df.columns])


def exists(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``key, found`` of each distinct key asked for: a left join with the distinct keys of the table."""
    have = df.select(key).distinct().withColumn("_found", F.lit(True))
    return keys.select(key).distinct().join(have, key, "left").select(key, F.coalesce("_found", F.lit(False)).alias("found"))


def cache_put(cache: DataFrame, new: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """The cache with the new rows in place of those with their key; of several new rows of a key the first by ``order``."""
    return upsert(cache, new, [key], order)


def ensure_tables(spark: SparkSession, root: str, schemas: dict[str, str]) -> list[str]:
    """Makes each table below ``root`` that isn't there yet, empty and with its schema; names those made. Run again, it makes none."""
    made = []
    for name, schema in schemas.items():
        try:
            spark.read.parquet(f"{root}/{name}").schema  # noqa: B018  the footer is read, no row
        except AnalysisException:
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
            made.append(name)
    return made


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of distinct keys."""
    keys = wanted.select(key).distinct()
    return keys.join(cache, key), keys.join(cache.select(key), key, "left_anti")


def embed_missing(wanted: DataFrame, cache: DataFrame, key: str, hook, schema: str) -> DataFrame:
    """The cache with the misses embedded: each distinct text goes to ``hook`` (an Arrow batch iterator function) once."""
    _, misses = cache_lookup(wanted, cache, key)
    return cache.unionByName(misses.mapInArrow(hook, schema))


def insert_defaults(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"period_basis": F.coalesce("period_basis", F.lit("unknown")), "confidence": F.coalesce("confidence", F.lit(0.5))})
