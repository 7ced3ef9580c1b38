"""Resolving subjects onto entities: exact name, alias, postal address, similar wording, vector, else a new entity.

Every distinct canonical subject is resolved once. Exact and alias are joins. Addresses meet on their postal code. Names of
similar wording meet on segments, vectors in tiles (``namejoin``); no list of names comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.fuzzy import token_set
from factloom.functions.subject import canonical_subject, guess_entity_type, normalize_address, types_compatible
from factloom.functions.text import entity_key
from factloom.operators.namejoin import similar_names, similar_vectors
from factloom.session import materialise


def entity_names(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical names, aliases) -> ``entity_id, name, kind``; of several entities with one name the smallest id."""
    rows = entities.select("entity_id", "canonical_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("al"), F.coalesce("entity_type", F.lit("unknown")).alias("kind")).dropDuplicates(["entity_id"])

    def one(df: DataFrame) -> DataFrame:
        return df.filter("name <> ''").groupBy("name").agg(F.min_by(F.struct("entity_id", "kind"), "entity_id").alias("e")).select("name", "e.entity_id", "e.kind")

    return one(rows.select("entity_id", canonical_subject("canonical_name").alias("name"), "kind")), one(rows.select("entity_id", F.explode("al").alias("a"), "kind").select("entity_id", canonical_subject("a").alias("name"), "kind"))


def _first_best(df: DataFrame) -> DataFrame:
    """Of each ``name``'s rows the one of the highest score, of equal ones the smallest entity id."""
    w = Window.partitionBy("name").orderBy(F.desc("score"), "entity_id")
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def similar_entities(names: DataFrame, by_name: DataFrame, least: float) -> DataFrame:
    """``name, entity_id, other, score``: the entity of the most similar name, of a compatible type, for each ``name, guess``."""
    near = similar_names(names, by_name, least).join(names.select("name", "guess"), "name").join(by_name.select(F.col("name").alias("other"), "entity_id", "kind"), "other")
    return _first_best(near.filter(types_compatible(F.col("guess"), F.col("kind"))).select("name", "entity_id", "other", "score"))


def close_calls(names: DataFrame, by_name: DataFrame, fuzzy: float = 92.0, review: float = 86.0) -> DataFrame:
    """``subject, candidate, score, decision``: what was merged by less than three points, and what was kept separate above ``review``."""
    best = similar_entities(names, by_name, review).filter(F.col("score") < fuzzy + 3)
    decision = F.when(F.col("score") >= fuzzy, "merged").otherwise("kept_separate")
    return best.select(F.col("name").alias("subject"), F.col("other").alias("candidate"), F.round("score", 1).alias("score"), decision.alias("decision"))


def resolve_subjects(
    subjects: DataFrame, entities: DataFrame, subject_col: str = "subject_raw", fuzzy: float = 92.0, address: float = 80.0, cosine_least: float = 0.88, vector_col: str | None = None
) -> DataFrame:
    """``subject_col, canonical, entity_id, method, score`` of each distinct subject; method is exact, alias, address, fuzzy,
    embedding or new. Null and empty subjects resolve to nothing and are left out. With ``vector_col`` (one vector a subject)
    what wording leaves open is compared with the entities' vectors.
    """
    vec = F.min(vector_col) if vector_col else F.lit(None).cast("array<float>")
    rows = subjects.filter(F.col(subject_col).isNotNull()).groupBy(F.col(subject_col).alias("raw")).agg(vec.alias("vec"))
    rows = rows.withColumn("name", canonical_subject("raw")).filter("name <> ''")
    rows = materialise(rows, "subjects")
    distinct = rows.groupBy("name").agg(F.min("raw").alias("raw"), F.min("vec").alias("vec")).withColumn("guess", guess_entity_type("raw"))
    distinct = materialise(distinct, "names")
    by_name, by_alias = (materialise(df, "entity-names") for df in entity_names(entities))

    exact = distinct.join(by_name.select("name", "entity_id"), "name").select("name", "entity_id", F.lit("exact").alias("method"), F.lit(100.0).alias("score"))
    left = distinct.join(exact, "name", "left_anti")
    alias = left.join(by_alias.select("name", "entity_id"), "name").select("name", "entity_id", F.lit("alias").alias("method"), F.lit(100.0).alias("score"))
    left = left.join(alias, "name", "left_anti")

    spots = by_name.unionByName(by_alias).withColumn("adr", normalize_address("name")).filter("adr.postal_code is not null")
    homes = left.filter("guess = 'address'").withColumn("a", normalize_address("raw")).filter("a.postal_code is not null")
    close = homes.join(spots.select(F.col("adr.postal_code").alias("pc"), F.col("adr.normalized").alias("norm"), "entity_id"), F.col("a.postal_code") == F.col("pc"))
    close = close.withColumn("score", token_set(F.col("a.normalized"), F.col("norm"))).filter(F.col("score") >= address)
    placed = close.groupBy("name").agg(F.max_by(F.struct("entity_id", "score"), F.struct("score", "entity_id")).alias("m")).select("name", "m.entity_id", F.lit("address").alias("method"), "m.score")
    found = materialise(exact.unionByName(alias).unionByName(placed), "settled")
    left = distinct.join(found, "name", "left_anti")

    worded = similar_entities(left.select("name", "guess"), by_name, fuzzy).select("name", "entity_id", F.lit("fuzzy").alias("method"), "score")
    found = materialise(found.unionByName(worded), "worded")
    left = distinct.join(found, "name", "left_anti")
    if vector_col:
        ev = entities.select("entity_id", F.col("embedding").alias("vec")).dropDuplicates(["entity_id"])
        near = _first_best(similar_vectors(left.select("name", "vec"), ev, cosine_least))
        embedded = near.select("name", "entity_id", F.lit("embedding").alias("method"), (F.col("score") * 100).alias("score"))
        found = materialise(found.unionByName(embedded), "embedded")
        left = distinct.join(found, "name", "left_anti")
    made = left.select("name", entity_key("name", "guess").alias("entity_id"), F.lit("new").alias("method"), F.lit(0.0).alias("score"))
    return rows.select("raw", "name").join(found.unionByName(made), "name").select(F.col("raw").alias(subject_col), F.col("name").alias("canonical"), "entity_id", "method", "score")


def attach_aliases(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities with the canonical forms that were resolved onto them added to their aliases, and new entities made."""
    extra = resolved.groupBy("entity_id").agg(F.collect_set("canonical").alias("forms"), F.min("canonical").alias("name"), F.max("method").alias("m"), F.min("method").alias("least"))
    both = entities.dropDuplicates(["entity_id"]).join(extra, "entity_id", "full_outer")
    own = canonical_subject("canonical_name")
    aliases = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array_remove(F.coalesce("forms", F.array().cast("array<string>")), F.coalesce(own, F.col("name"))))
    return both.select("entity_id", F.coalesce("canonical_name", "name").alias("canonical_name"), F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.array_sort(aliases).alias("aliases"))
