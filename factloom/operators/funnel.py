"""Candidate pairs of facts: blocking on entity or predicate, cosine within the block, the best k on either side.

Blocks are compared in tiles: a block's facts are spread over tiles of about TILE rows, every pair of tiles is one unit of
work, and a tile pair emits only the pairs above the threshold, found by one matrix product. So a block with a third of all
facts is neither one task nor ever written out as pairs. Counting blocked pairs needs no pairs at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialise

TILE = 1000


def latest_facts(facts: DataFrame) -> DataFrame:
    """One row a fact: the last created, then the most confident."""
    w = Window.partitionBy("fact_id").orderBy(F.desc("created_at"), F.desc("confidence"), F.xxhash64("value_raw", "unit_raw"))
    return facts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def scoped_facts(facts: DataFrame, evidence: DataFrame, documents: DataFrame, embeddings: DataFrame, dim: int = 64) -> DataFrame:
    """Facts with verified evidence and a usable vector, with their document's collection. Only the columns the funnel needs."""
    e = evidence.filter("verified").select("evidence_id").distinct()
    d = documents.select("doc_id", "collection").distinct()
    usable = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: F.isnan(x) | x.isNull()) & F.exists("embedding", lambda x: x != 0)
    v = embeddings.filter(usable).select("fact_id", "embedding").dropDuplicates(["fact_id"])
    f = latest_facts(facts).select("fact_id", "doc_id", "chunk_id", "entity_id", "predicate_canonical", "value_type", "unit_dimension", "evidence_id")
    return f.join(e, "evidence_id", "left_semi").join(d, "doc_id").join(v, "fact_id").drop("evidence_id")


def count_blocked_pairs(scoped: DataFrame, same_collection: bool = True) -> DataFrame:
    """One row, ``n_pairs``: how many pairs blocking leaves, by inclusion and exclusion over group counts.

    Pairs of equal entity, plus pairs of equal predicate, less pairs of both. Within a group, pairs of different stated
    dimensions don't count, nor do pairs of one chunk.
    """

    def pairs(keys: list[str]) -> DataFrame:
        keys = [*keys, "value_type", *(["collection"] if same_collection else [])]
        rows = reduce(lambda df, k: df.filter(F.col(k).isNotNull()), keys, scoped)

        def compatible(by: list[str]) -> DataFrame:
            n = rows.groupBy(*by, "unit_dimension").agg(F.count("*").alias("n"))
            known = F.when(F.col("unit_dimension").isNotNull(), F.col("n")).otherwise(0)
            g = n.groupBy(*by).agg(F.sum("n").alias("all"), F.sum(known).alias("k"), F.sum(known * known).alias("kk"))
            return g.agg(F.sum((F.col("all") * (F.col("all") - 1) - (F.col("k") * F.col("k") - F.col("kk"))) / 2).alias("p"))

        return compatible(keys).select("p").unionByName(compatible([*keys, "chunk_id"]).select((-F.col("p")).alias("p")))

    parts = pairs(["entity_id"]).unionByName(pairs(["predicate_canonical"])).unionByName(pairs(["entity_id", "predicate_canonical"]).select((-F.col("p")).alias("p")))
    return parts.agg(F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("n_pairs"))


def _tile_pairs(scoped: DataFrame, key: str, same_collection: bool, threshold: float) -> DataFrame:
    keys = [key, "value_type", *(["collection"] if same_collection else [])]
    rows = reduce(lambda df, k: df.filter(F.col(k).isNotNull()), keys, scoped)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).select(*keys, "tiles")
    tiled = rows.join(sizes, keys).withColumn("t", F.pmod(F.xxhash64("fact_id"), "tiles").cast("int"))
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    units = F.transform(other, lambda u: F.struct(F.least(u, F.col("t")).alias("i"), F.greatest(u, F.col("t")).alias("j")))
    spread = tiled.select(F.xxhash64(*keys).alias("b1"), F.xxhash64(F.lit(7), *keys).alias("b2"), F.explode(units).alias("u"), "t", "fact_id", "chunk_id", "unit_dimension", "is_new", "embedding")
    spread = spread.select("b1", "b2", "u.i", "u.j", "t", "fact_id", "chunk_id", "unit_dimension", "is_new", "embedding")
    names = ["b1", "b2", "i", "j", "t", "fact_id", "chunk_id", "unit_dimension", "is_new", "embedding"]

    def compare(unit: list[list]) -> pa.RecordBatch:
        _, _, i, j, t, fact, chunk, dim, new, vec = unit
        x = np.array(vec, np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        tile = np.array(t)
        a = np.flatnonzero(tile == i[0])
        b = np.flatnonzero(tile == j[0])
        sim = x[a] @ x[b].T
        ids, chunks = np.array(fact, object), np.array(chunk, object)
        code = {d: k for k, d in enumerate(sorted({d for d in dim if d is not None}))}
        dims = np.array([code.get(d, -1) for d in dim])
        fresh = np.array(new, bool)
        r, c = np.nonzero(sim >= threshold)
        s, (r, c) = sim[r, c], (a[r], b[c])
        ok = (chunks[r] != chunks[c]) & ((dims[r] == dims[c]) | (dims[r] < 0) | (dims[c] < 0)) & (fresh[r] | fresh[c])
        ok &= (ids[r] < ids[c]) if i[0] == j[0] else (ids[r] != ids[c])
        r, c, s = r[ok], c[ok], s[ok]
        swap = ids[r] > ids[c]
        r, c = np.where(swap, c, r), np.where(swap, r, c)
        return pa.RecordBatch.from_arrays([pa.array(ids[r], pa.string()), pa.array(ids[c], pa.string()), pa.array(s)], names=["fact_a", "fact_b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, unit = None, [[] for _ in names]
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if row[:4] != at:
                    if unit[0]:
                        yield compare(unit)
                    at, unit = row[:4], [[] for _ in names]
                for cell, v in zip(unit, row):
                    cell.append(v)
        if unit[0]:
            yield compare(unit)

    return spread.repartition("b1", "b2", "i", "j").sortWithinPartitions("b1", "b2", "i", "j").mapInArrow(run, "fact_a string, fact_b string, similarity double")


def generate_candidates(
    scoped: DataFrame, top_k: int = 12, threshold: float = 0.80, existing: DataFrame | None = None, new_docs: DataFrame | None = None, same_collection: bool = True
) -> DataFrame:
    """``fact_a < fact_b, similarity``: pairs above the threshold that are among the ``top_k`` of their fact_a or of their fact_b.

    ``existing`` links (``fact_a, fact_b``) are left out before ranking; with ``new_docs`` (``doc_id``) only pairs that touch
    one of those documents count. Facts without entity and predicate meet nobody. Ties are broken by the other fact's id.
    """
    if new_docs is None:
        rows = scoped.withColumn("is_new", F.lit(True))
    else:
        marked = new_docs.select("doc_id").distinct().withColumn("is_new", F.lit(True))
        rows = scoped.join(marked, "doc_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    met = _tile_pairs(rows, "entity_id", same_collection, threshold).unionByName(_tile_pairs(rows, "predicate_canonical", same_collection, threshold))
    pairs = met.groupBy("fact_a", "fact_b").agg(F.max("similarity").alias("similarity"))
    if existing is not None:
        pairs = pairs.join(existing.select("fact_a", "fact_b"), ["fact_a", "fact_b"], "left_anti")
    pairs = materialise(pairs, "near-pairs")  # ranked twice

    def best(side: str, other: str) -> DataFrame:
        w = Window.partitionBy(side).orderBy(F.desc("similarity"), other)
        return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_k).drop("_r")

    return best("fact_a", "fact_b").unionByName(best("fact_b", "fact_a")).distinct()


def cosine(a: Column, b: Column) -> Column:
    """In doubles; a zero vector has similarity 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def residue_budget(residue: DataFrame, budget: int = 75) -> DataFrame:
    """The ``budget`` most similar undecided pairs of each document (``doc_id``); the rest is marked ``deferred``."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "fact_a", "fact_b")
    return residue.withColumn("deferred", F.row_number().over(w) > budget)
