"""Pairs of names of similar wording, and of similar vectors, without comparing all with all.

Wording: the ratio by insertions and deletions of at least ``least`` leaves a name of m letters at most d of them, so of d + 1
segments it is cut into one stands unchanged in the other name, shifted by no more than the edits before and after it allow.
Segments are joined with the substrings of the other names, and what meets is verified; the segments are some six letters long
at 92, whatever the names' length. Vectors: one side in tiles of a bounded size, the other streamed past each by matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.fuzzy import ratio
from factloom.session import cores

#: Vectors in one tile, and rows streamed past one task's copy of it.
TILE, STREAM = 20_000, 50_000


@lru_cache(maxsize=4096)
def _edits(m: int, least: float) -> tuple[int, int, int]:
    """(edits, shortest, longest partner) of a name of ``m`` letters at a ratio of ``least``."""
    share = least / 100
    longest = math.floor(m * (2 - share) / share + 1e-9)
    return math.floor((1 - share) * (m + longest) + 1e-9), math.ceil(m * share / (2 - share) - 1e-9), longest


@lru_cache(maxsize=4096)
def _segments(m: int, d: int) -> tuple[tuple[int, int], ...]:
    d = min(d, max(m - 1, 0))
    cuts = [m * i // (d + 1) for i in range(d + 2)]
    return tuple((s, e - s) for s, e in zip(cuts, cuts[1:]))


def segment_keys(name: str, least: float) -> list[str]:
    d, _, _ = _edits(len(name), least)
    return [f"{len(name)}.{i}.{name[s : s + n]}" for i, (s, n) in enumerate(_segments(len(name), d))]


def window_keys(name: str, least: float) -> set[str]:
    """Keys of every name of a ratio of at least ``least`` to ``name``: each possible segment at each possible shift."""
    n, out = len(name), set()
    _, low, high = _edits(n, least)
    for m in range(low, high + 1):
        d, _, _ = _edits(m, least)
        d = min(d, math.floor((1 - least / 100) * (n + m) + 1e-9))
        delta = n - m
        full, _, _ = _edits(m, least)
        for i, (s, size) in enumerate(_segments(m, full)):
            for at in range(max(0, s - d), min(n - size, s + d) + 1):
                shift = at - s
                if abs(shift) + abs(delta - shift) <= d:
                    out.add(f"{m}.{i}.{name[at : at + size]}")
    return out


def _keyed(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, k) for s in b.column(0).to_pylist() for k in make(s)]
            cols = list(zip(*rows)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["name", "key"])

    return run


def similar_names(left: DataFrame, right: DataFrame, least: float = 92.0) -> DataFrame:
    """``name, other, score``: all pairs of ``left.name`` and ``right.name`` whose words, sorted, have a ratio of at least ``least``.

    Null names have no pair; both sides are made distinct, so a name that many rows hold is compared once.
    """
    words = lambda df: df.select("name", F.array_join(F.array_sort(F.filter(F.split("name", r"\s+"), lambda w: w != "")), " ").alias("s")).filter("s <> ''").distinct()
    a, b = words(left), words(right).select(F.col("name").alias("other"), F.col("s").alias("t"))
    n = cores()
    probes = a.select("s").distinct().repartition(n).mapInArrow(_keyed(lambda s: window_keys(s, least)), "name string, key string").toDF("s", "key")
    held = b.select("t").distinct().repartition(n).mapInArrow(_keyed(lambda t: segment_keys(t, least)), "name string, key string").toDF("t", "key")
    met = probes.join(held.hint("shuffle_hash"), "key").select("s", "t").distinct()
    total = F.length("s") + F.length("t")
    odd = F.expr("length(translate(s, t, '')) + length(translate(t, s, ''))")  # letters that only one side has: each is an edit
    met = met.filter(odd <= total * (1 - least / 100) + 1e-9)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([ratio(s, t) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.float64())], names=["s", "t", "score"])

    good = met.repartition(n).mapInArrow(verify, "s string, t string, score double").filter(F.col("score") >= least)
    return good.join(a, "s").join(b, "t").select("name", "other", "score")


def similar_vectors(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``name, entity_id, score``: pairs of ``left (name, vec)`` and ``right (entity_id, vec)`` with a cosine of at least ``least``.

    Vectors of different lengths, null or zero ones have none. Each tile of ``right`` meets all rows of ``left`` in blocks; only
    pairs over the floor are ever written.
    """
    left, right = left.filter("vec is not null"), right.filter("vec is not null")
    n_right, n_left = right.count(), left.count()
    tiles, salts = max(1, -(-n_right // TILE)), max(1, -(-n_left // STREAM))
    salt = F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")
    none = F.lit(None).cast("string")
    held = right.select(F.pmod(F.xxhash64("entity_id"), F.lit(tiles)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), none.alias("name"), "entity_id", F.col("vec").cast("array<double>").alias("vec"))
    asked = left.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), salt.alias("salt"), F.lit(1).alias("kind"), "name", none.alias("entity_id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = held.unionByName(asked).repartition("tile", "salt").sortWithinPartitions("tile", "salt", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, tile, out = None, [], [], {}, [[], [], []]
        for b in batches:
            for o in out:
                o.clear()
            for t, s, kind, name, entity, vec in zip(*(b.column(c).to_pylist() for c in ("tile", "salt", "kind", "name", "entity_id", "vec"))):
                if (t, s) != at:
                    at, ids, vectors, tile = (t, s), [], [], {}
                v = np.array([np.nan if x is None else x for x in vec], float)
                length = np.sqrt((v * v).sum())
                if not length > 0 or not np.isfinite(length):
                    continue
                if kind == 0:
                    ids.append(entity)
                    vectors.append(v / length)
                    continue
                if len(v) not in tile:
                    same = [i for i, x in enumerate(vectors) if len(x) == len(v)]
                    tile[len(v)] = ([ids[i] for i in same], np.array([vectors[i] for i in same]).reshape(-1, len(v)))
                names, m = tile[len(v)]
                score = m @ (v / length)
                for i in np.flatnonzero(score >= least):
                    for o, x in zip(out, (name, names[i], float(score[i]))):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, x) for o, x in zip(out, (pa.string(), pa.string(), pa.float64()))], names=["name", "entity_id", "score"])

    return rows.mapInArrow(compare, "name string, entity_id string, score double")
