"""The most similar vectors of every vector: a neighbour graph by NN-descent, and greedy search on it.

The first graph comes from random cross-polytope buckets: every vector meets the others of its bucket in each of
``tables`` hash tables. A bucket too large for one task is hashed further, by what its vectors differ in: by fresh rotations
of their differences from the bucket's centre, twice, and again until no piece is too large. NN-descent then joins the graph with itself: two neighbours of one node are compared, and each node
keeps its best, until hardly an edge changes. Equal vectors are one node throughout (they are merged within every batch
before anything is shuffled) and are expanded at the end. Similarities are exact: candidates are found on one byte a
number, and settled on the vectors themselves.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import BROADCAST_ROWS, materialise, small_or_shuffled

#: Most rows of a bucket that one task compares with one another; a larger bucket is hashed further into pieces of about a quarter.
BUCKET_ROWS = 16384
#: Hashes of the differences from the centre that each bucket too large gets.
RESIDUAL_TABLES = 2
#: Levels of further hashing. What is still too large then has one direction within rounding, and any piece of it will do.
LEVELS = 12
#: Wanted rows of a bucket where only pairs over a floor are wanted; the number of buckets follows from it.
AIM = 200
#: Wanted rows of a bucket without a floor: the nearest may be hardly nearer than others, so a row has to meet many.
DENSE = 8192
#: Without a floor there are at least as many tables as doublings from this many vectors, since a row then meets a smaller share.
TABLES_FROM = 2048


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors) of the rows with ``dim`` numbers, none null or NaN or infinite, not all zero."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        lengths = np.asarray(column.value_lengths().fill_null(0))
        rows = np.flatnonzero(lengths == dim)
        if not len(rows):
            return rows, np.zeros((0, dim), np.float32)
        flat = column.take(pa.array(rows)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        return rows[good], x[good]
    raise TypeError("vectors must be arrays of numbers")


def unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def _bytes_of(column: pa.Array, kind) -> np.ndarray:
    """Rows of a binary column whose values are equally long, without an object a row."""
    if not len(column):
        return np.zeros((0, 1), kind)
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of float32 numbers."""
    return _bytes_of(column, np.float32)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: dict[str, Callable[[pa.Array], np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of batches sorted by ``keys``, each as arrays of its ``columns``; a group may run over several batches."""
    held: list[dict[str, np.ndarray]] = []
    at = None

    def whole() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in columns}

    for b in batches:
        if not b.num_rows:
            continue
        ks = [_numbers(b.column(k)) for k in keys]
        cols = {c: f(b.column(c)) for c, f in columns.items()}
        change = np.zeros(b.num_rows, bool)
        for k in ks:
            change[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if at != (now := tuple(int(k[s]) for k in ks)):
                if held:
                    yield whole()
                at, held = now, []
            held.append({c: v[s:e] for c, v in cols.items()})
    if held:
        yield whole()


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s.astype(np.float32), pa.float32())], names=["a", "b", "s"])


def _one_byte(x: np.ndarray) -> pa.Array:
    """The vectors scaled to one byte a number."""
    y = x.astype(np.float32) / np.abs(x).max(1, keepdims=True) if len(x) else x
    data = np.ascontiguousarray(np.rint(y * 127).astype(np.int8))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * data.shape[1]), pa.py_buffer(data)]) if len(x) else pa.array([], pa.binary())


class Hasher:
    """Bucket numbers by ``depth`` concatenated cross-polytope hashes of random rotations, cut to ``width`` directions."""

    def __init__(self, dim: int, n: int, tables: int, seed: int, aim: int = AIM):
        wanted = max(2.0, n / aim)
        self.depth = max(1, math.ceil(math.log(wanted) / math.log(2 * dim)))
        self.depth = max(self.depth, 2 if wanted > 2 * dim else 1)
        self.width = min(dim, max(1, round(wanted ** (1 / self.depth) / 2)))
        rng = np.random.default_rng(seed)
        self.rotations = [
            [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : self.width].astype(np.float32) for _ in range(self.depth)] for _ in range(tables)
        ]

    def codes(self, x: np.ndarray) -> Iterator[np.ndarray]:
        rows = np.arange(len(x))
        for table, rotations in enumerate(self.rotations):
            code = np.full(len(x), table, np.int64)
            for r in rotations:
                y = x @ r
                at = np.abs(y).argmax(1)
                code = code * (2 * self.width) + 2 * at + (y[rows, at] < 0)
            yield code


def _mixed(code: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
    """64-bit mix of whole numbers."""
    z = code.astype(np.uint64)
    for m in more:
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(m).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.int64)


class Splitter:
    """Divides buckets that are too large by similarity: what their vectors differ from the centre by is hashed further.

    Each level holds the buckets that are still too large, with their size and the mean of their unit vectors.
    """

    def __init__(self, dim: int, tables: int, seed: int):
        self.dim, self.tables, self.seed = dim, tables, seed
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, sizes: dict[int, int], centres: dict[int, np.ndarray]) -> None:
        keys = np.array(sorted(sizes), np.int64)
        self.levels.append((keys, np.array([sizes[k] for k in keys.tolist()], np.int64), np.array([centres[k] for k in keys.tolist()])))

    def _rotation(self, table: int, level: int, j: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, 1 + table, level, j])
        return np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]

    def pieces(self, u: np.ndarray, codes: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(table, rows, their codes, levels passed) of unit vectors; a row of a large bucket comes in several pieces."""
        for table, code in enumerate(codes):
            todo = [(np.arange(len(u)), code)]
            for level, (keys, sizes, centres) in enumerate(self.levels):
                after = []
                for rows, c in todo:
                    at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                    large = keys[at] == c
                    if not large.all():
                        yield table, rows[~large], c[~large], level
                    rows, c, at = rows[large], c[large], at[large]
                    if not len(rows):
                        continue
                    width = np.clip(np.rint(sizes[at] / (BUCKET_ROWS / 4) / 2), 1, self.dim)
                    for j in range(1 if level else RESIDUAL_TABLES):
                        y = (u[rows] - centres[at]) @ self._rotation(table, level, j)
                        size = np.where(np.arange(self.dim) < width[:, None], np.abs(y), -1)
                        best = size.argmax(1)
                        side = 2 * best + (y[np.arange(len(y)), best] < 0)
                        after.append((rows, _mixed(c, level, j, side)))
                todo = after
            for rows, c in todo:
                yield table, rows, c, len(self.levels)


def _top(sim: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest values of at least ``floor``."""
    good = sim >= floor
    n = good.sum(1)
    many = np.flatnonzero(n > k)
    few = np.flatnonzero((n > 0) & (n <= k))
    r, c = np.nonzero(good[few])
    if not len(many):
        return few[r], c
    top = np.argpartition(-sim if len(many) == len(sim) else -sim[many], k - 1, axis=1)[:, :k]
    return np.concatenate([few[r], np.repeat(many, k)]), np.concatenate([c, top.ravel()])


def as_units(q8: np.ndarray) -> np.ndarray:
    """Unit vectors of one byte a number."""
    x = q8.astype(np.float32)
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-9)


def _bucket_edges(nodes: np.ndarray, q8: np.ndarray, k: int, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each node's ``k`` best others of the bucket: (a, b, similarity)."""
    nodes, keep = np.unique(nodes, return_index=True)
    x = as_units(q8[keep])
    for s in range(0, len(x) if len(x) > 1 else 0, 512):
        sim = x[s : s + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -3
        r, c = _top(sim, k, floor)
        yield nodes[r + s], nodes[c], sim[r, c]


def _best_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` best different ``b`` of each ``a``."""
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # equal pairs have equal similarity and stand side by side
    order, a = order[new], a[new]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    return order[rank < k]


def _local_join(k: int):
    """Arrow function on rows ``at, x, new, q8, kth``, sorted by ``at``: compares each node's neighbours.

    A pair is worth an edge to the side whose ``kth`` similarity it beats; pairs without a new neighbour were met before.
    Of what one task finds for a node its ``k`` best are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        columns = {"x": _numbers, "new": _numbers, "q8": lambda c: _bytes_of(c, np.int8), "kth": _numbers}
        for g in _groups(batches, ("at",), columns):
            x, at = np.unique(g["x"], return_index=True)
            fresh = np.zeros(len(x), bool)
            np.logical_or.at(fresh, np.searchsorted(x, g["x"]), g["new"].astype(bool))
            if len(x) < 2 or not fresh.any():
                continue
            u, want = as_units(g["q8"][at]), g["kth"][at]
            sim = u @ u.T
            good = (sim > want[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(good, False)
            r, c = np.nonzero(good)
            held.append((x[r], x[c], sim[r, c]))
            size += len(r)
            if size > 400_000:
                a, b, s = (np.concatenate(h) for h in zip(*held))
                keep = _best_of(a, b, s, k)
                held, size = [], 0
                yield _edges(a[keep], b[keep], s[keep])
        if held:
            a, b, s = (np.concatenate(h) for h in zip(*held))
            keep = _best_of(a, b, s, k)
            yield _edges(a[keep], b[keep], s[keep])

    return run


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = unit(vectors_of(batch.column("va"))), unit(vectors_of(batch.column("vb")))
            s = np.minimum(np.einsum("ij,ij->i", x, y), 1.0)
        else:
            s = np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s)], names=["a", "b", "s"])


def with_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, s): exact cosine."""
    va, vb = vectors.select(F.col("node").alias("a"), F.col("vec").alias("va")), vectors.select(F.col("node").alias("b"), F.col("vec").alias("vb"))
    return pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(_similarity, "a bigint, b bigint, s double")


def _best(edges: DataFrame, k: int, by: str = "a", other: str = "b") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("s"), other)
    return edges.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _top_distinct(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best different ``b`` of each ``a``, by one shuffle: a pair given twice has one similarity and so one rank."""
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    ranked = edges.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= k)
    return ranked.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Materialised ``id, node, vec, first``: ``node`` is the vector's digest, ``first`` marks one row of equal ones a batch.

    The digest has 64 bits: among a hundred million different vectors two share one with a probability of 0.03%.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = usable(b.column("vec"), dim)
            x = x + np.float32(0)  # one zero
            data = [r.tobytes() for r in x]
            node = [int.from_bytes(hashlib.md5(d).digest()[:8], "little", signed=True) for d in data]
            seen: set[bytes] = set()
            first = [not (n in seen or seen.add(n)) for n in node]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows, pa.int64())), pa.array(node, pa.int64()), pa.array([d if f else None for d, f in zip(data, first)], pa.binary()), pa.array(first, pa.bool_())],
                names=["id", "node", "vec", "first"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return materialise(rows.mapInArrow(read, f"id {kind}, node bigint, vec binary, first boolean"), "vectors")


def neighbour_graph(
    held: DataFrame, dim: int, k: int = 8, floor: float | None = None, tables: int = 6, rounds: int | None = None, tolerance: float = 0.002, seed: int = 7, report: list | None = None
) -> tuple[DataFrame, DataFrame]:
    """(edges ``a, b, s``: each node's ``k`` best other nodes found; vectors ``node, vec``: all, with ``floor`` those of nodes with edges).

    The descent goes on until at most ``tolerance`` of the edges change, or for ``rounds`` if given. Each round only replaces
    edges by better ones, so it ends. ``report`` takes (changed, all) edges of each round.

    With ``floor``, edges below that cosine are left out from the start. ``held`` is what ``usable_vectors`` gives.
    """
    firsts = held.filter("first").select("node", "vec")
    n = firsts.count()
    if floor is None:
        tables = max(tables, math.ceil(math.log2(max(n, 1) / TABLES_FROM)))
    hasher, splitter = Hasher(dim, n, tables, seed, DENSE if floor is None else AIM), Splitter(dim, tables, seed)
    low = -2.0 if floor is None else floor - 0.02  # what one byte a number may be off by
    limit = max(BUCKET_ROWS, n * tables // BROADCAST_ROWS)  # so that large buckets are at most BROADCAST_ROWS

    def pieces(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        return splitter.pieces(unit(x), hasher.codes(x)) if len(x) else iter(())

    def too_large() -> dict[int, int]:
        """Sizes of the last level's pieces that are over the limit."""
        last = len(splitter.levels)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = [c for _, _, c, level in pieces(vectors_of(b.column("vec"))) if level == last]
                u, c = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["bucket", "n"])

        sizes = firsts.select("vec").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
        return {r.bucket: r.n for r in sizes.filter(F.col("n") > limit).collect()}

    def centres_of(large: dict[int, int]) -> dict[int, np.ndarray]:
        last, keys = len(splitter.levels), np.array(sorted(large), np.int64)
        names = [f"x{i}" for i in range(dim)]

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = vectors_of(b.column("vec"))
                sums = np.zeros((len(keys), dim))
                for _, rows, c, level in pieces(x):
                    if level == last:
                        at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                        ok = keys[at] == c
                        np.add.at(sums, at[ok], unit(x[rows[ok]]))
                some = np.flatnonzero(sums.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), *(pa.array(sums[some, i]) for i in range(dim))], names=["bucket", *names])

        sums = firsts.select("vec").mapInArrow(add_up, "bucket bigint, " + ", ".join(f"{c} double" for c in names)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names))
        got = {r[0]: np.array(r[1:]) / large[r[0]] for r in sums.collect()}
        return {k: got.get(k, np.zeros(dim)) for k in large}

    large = too_large()
    while large and len(splitter.levels) < LEVELS:
        splitter.add(large, centres_of(large))
        large = too_large()
    even = {bucket: -(-size // BUCKET_ROWS) for bucket, size in large.items()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors_of(b.column("vec"))
            if not len(x):
                continue
            q8 = _one_byte(x)
            node = b.column("node")
            salt = _numbers(node).astype(np.uint64)
            if floor is None:  # a row that is alone in all its buckets starts from random others
                anywhere = -1 - (_mixed(salt, tables) >> 1 & 0x7FFFFFFF) % max(1, n // DENSE)
                yield pa.RecordBatch.from_arrays([pa.array(anywhere), pa.array(np.zeros(len(x), np.int32)), node, q8], names=["bucket", "piece", "node", "q8"])
            for table, rows, code, _ in pieces(x):
                parts = np.array([even.get(c, 1) for c in code.tolist()], np.int64) if even else np.ones(len(code), np.int64)
                piece = ((_mixed(salt[rows], table, code) >> 1 & 0x7FFFFFFF) % parts).astype(np.int32)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(piece), node.take(take), q8.take(take)], names=["bucket", "piece", "node", "q8"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("bucket", "piece"), {"node": _numbers, "q8": lambda c: _bytes_of(c, np.int8)}):
            for a, b, s in _bucket_edges(g["node"], g["q8"], k, low):
                yield _edges(a, b, s)

    buckets = firsts.mapInArrow(spread, "bucket bigint, piece int, node bigint, q8 binary").repartition("bucket", "piece").sortWithinPartitions("bucket", "piece")
    met = buckets.mapInArrow(meet, "a bigint, b bigint, s float").withColumn("new", F.lit(True))
    graph = materialise(_top_distinct(met, k), "graph-0")
    wanted = firsts
    if floor is not None:
        nodes = materialise(graph.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        wanted = firsts.join(small_or_shuffled(nodes), "node", "left_semi")
    vectors = materialise(wanted.dropDuplicates(["node"]), "node-vectors")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), _one_byte(vectors_of(b.column("vec")))], names=["node", "q8"])

    small = materialise(vectors.mapInArrow(shrink, "node bigint, q8 binary"), "node-bytes")
    side = Window.partitionBy("at", "back").orderBy(F.desc("s"), "x")
    for i in itertools.count() if rounds is None else range(rounds):
        out = graph.select(F.col("a").alias("at"), F.col("b").alias("x"), "s", "new", F.lit(False).alias("back"))
        back = graph.select(F.col("b").alias("at"), F.col("a").alias("x"), "s", "new", F.lit(True).alias("back"))
        # a node's reverse neighbours are kept to the best k; both kinds meet in one shuffle by the node
        near = out.unionByName(back).withColumn("_r", F.row_number().over(side)).filter(F.col("_r") <= k)
        near = near.withColumn("any", F.max("new").over(Window.partitionBy("at"))).filter("any").select("at", "x", "new")  # nothing new to compare elsewhere
        kth = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(low).cast("float").alias("kth"))
        known = small.join(kth, small["node"] == kth["a"], "left").select("node", "q8", F.coalesce("kth", F.lit(low).cast("float")).alias("kth"))
        rows = near.join(known, near["x"] == known["node"]).select("at", "x", "new", "q8", "kth")
        met = rows.repartition("at").sortWithinPartitions("at").mapInArrow(_local_join(k), "a bigint, b bigint, s float")
        merged = graph.withColumn("new", F.lit(False)).select("a", "b", "s", "new").unionByName(met.withColumn("new", F.lit(True)))
        graph = materialise(_top_distinct(merged, k), f"graph-{i + 1}")
        changed, total = graph.agg(F.count_if("new"), F.count("*")).first()
        if report is not None:
            report.append((changed, total))
        if changed <= tolerance * total:
            break
    pairs = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    exact = materialise(with_similarity(pairs, vectors), "edges")
    if floor is not None:
        exact = exact.filter(F.col("s") >= floor)
    return _best(exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")), k), vectors


def most_similar(
    df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 5, floor: float | None = None, graph_k: int | None = None, tables: int = 6, rounds: int | None = None
) -> DataFrame:
    """Each row's ``k`` most similar others: ``id, other, s``, ties by the smaller id.

    Rows whose vector has not ``dim`` finite numbers or is all zero take no part, nor do null ids; rows given twice count
    once. With ``floor`` only similarities of at least that are wanted, and far less is kept. Equal vectors have similarity 1;
    of a group of them each row gets the ``k`` smallest other ids, however large the group is.
    """
    held = usable_vectors(df, id_col, vec_col, dim)
    edges, _ = neighbour_graph(held, dim, graph_k or k + 3, floor, tables, rounds)
    members = held.select("id", "node").distinct()
    few = _best(members.withColumn("s", F.lit(1.0)), k + 1, "node", "id").select("node", "id")
    own = few.select("node", F.col("id").alias("other"), F.lit(1.0).alias("s"))
    others = edges.join(few.select(F.col("node").alias("b"), F.col("id").alias("other")), "b").select(F.col("a").alias("node"), "other", "s")
    lists = _best(own.unionByName(others), k + 1, "node", "other")
    lists = materialise(lists.groupBy("node").agg(F.collect_list(F.struct("other", "s")).alias("near")).filter(F.size("near") > 1), "lists")
    flat = members.join(small_or_shuffled(lists, limit=20_000), "node").select("id", F.explode("near").alias("x")).select("id", "x.other", "x.s").filter("id <> other")
    return _best(flat, k, "id", "other")


def measured_recall(df: DataFrame, near: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, asked: int = 200) -> DataFrame:
    """``n_asked, recall``: how many of the true ``k`` nearest of ``asked`` rows (those of the smallest id hashes) ``near`` has.

    ``near`` is what ``most_similar`` gives. The rows asked for are a bounded sample, for the measure only; they are compared with
    every row of the table. Of rows equally similar to the k-th any counts.
    """
    held = usable_vectors(df, id_col, vec_col, dim)
    ids = held.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(asked)
    firsts = held.filter("first").select("node", "vec").dropDuplicates(["node"])
    picked = held.join(F.broadcast(ids), "id").select("id", "node").distinct().join(firsts, "node").toArrow()  # at most ``asked`` rows
    names, own = picked.column("id").to_pylist(), unit(vectors_of(picked.column("vec").combine_chunks())) if picked.num_rows else np.zeros((0, dim))
    kind = df.schema[id_col].dataType.simpleString()
    id_type = picked.schema.field("id").type

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = usable(b.column("vec"), dim)
            if not len(rows) or not len(names):
                continue
            s = own @ unit(x).T
            r, c = _top(s, min(k + 1, s.shape[1]), -2.0)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in r.tolist()], id_type), b.column("id").take(pa.array(rows[c])), pa.array(s[r, c])], names=["id", "other", "s"])

    every = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter("id is not null and vec is not null").mapInArrow(compare, f"id {kind}, other {kind}, s double")
    best = _best(every.filter("id <> other").groupBy("id", "other").agg(F.max("s").alias("s")), k, "id", "other")
    truth = best.groupBy("id").agg(F.min("s").alias("kth"), F.count("*").alias("n"))
    got = near.join(F.broadcast(truth), "id").groupBy("id").agg(F.count_if(F.col("s") >= F.col("kth") - 1e-6).alias("hit"))
    return truth.join(got, "id", "left").agg(F.count("*").alias("n_asked"), (F.sum(F.coalesce("hit", F.lit(0))) / F.sum("n")).alias("recall"))


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 5, floor: float = 0.9) -> DataFrame:
    """``id_a < id_b``: one is among the other's ``k`` most similar, with a cosine of at least ``floor``.

    The graph keeps edges down to 0.1 below the floor, over which the descent finds its way.
    """
    near = most_similar(df, id_col, vec_col, dim, k, floor - 0.1).filter(F.col("s") >= floor)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def greedy_search(
    queries: DataFrame, edges: DataFrame, vectors: DataFrame, dim: int, k: int = 5, beam: int = 16, entries: int = 32, max_steps: int | None = None, seed: int = 11
) -> DataFrame:
    """``qid, node, s``: for each query (``qid, vec``) the ``k`` best nodes that greedy search finds on the graph.

    Every query starts from a few common nodes and up to ``entries`` nodes of each of its hash buckets; each step
    opens the unopened nodes among its ``beam`` best and keeps the ``beam`` best of all seen. It ends when no query has any
    left to open (a node that fell out of the beam never comes back, so it ends), or after ``max_steps`` if given. Queries move through joins with the graph, never through the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    qv = materialise(queries.select("qid", F.col("vec").alias("qvec")).distinct(), "queries")
    n = vectors.count()
    hasher = Hasher(dim, n, 4, seed)

    def bucket(column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = vectors_of(b.column("vec"))
                for code in hasher.codes(x) if len(x) else ():
                    yield pa.RecordBatch.from_arrays([b.column(column), pa.array(code)], names=[column, "bucket"])

        return run

    kind = queries.schema["qid"].dataType.simpleString()
    per = Window.partitionBy("bucket").orderBy("node")
    homes = vectors.select("node", "vec").mapInArrow(bucket("node"), "node bigint, bucket bigint").withColumn("_r", F.row_number().over(per)).filter(F.col("_r") <= entries).drop("_r")
    starts = queries.select("qid", "vec").mapInArrow(bucket("qid"), f"qid {kind}, bucket bigint").join(homes, "bucket").select("qid", "node")
    anyone = F.broadcast(vectors.select("node").orderBy(F.xxhash64("node")).limit(4))
    starts = starts.unionByName(qv.select("qid").crossJoin(anyone).select("qid", "node")).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(0)
            if b.num_rows:
                s = np.minimum(np.einsum("ij,ij->i", unit(vectors_of(b.column("qvec"))), unit(vectors_of(b.column("vec")))), 1.0)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("node"), pa.array(s)], names=["qid", "node", "s"])

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(vectors, "node").join(qv, "qid").select("qid", "node", "qvec", "vec")
        return rows.mapInArrow(compare, f"qid {kind}, node bigint, s double")

    def best(rows: DataFrame, m: int) -> DataFrame:
        w = Window.partitionBy("qid").orderBy(F.desc("s"), "node")
        return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m).drop("_r")

    state = materialise(best(measured(starts), beam).withColumn("open", F.lit(True)), "beam-0")
    for i in itertools.count() if max_steps is None else range(max_steps):
        if state.filter("open").isEmpty():
            break
        frontier = state.filter("open").join(both, state["node"] == both["a"]).select("qid", F.col("b").alias("node")).distinct()
        fresh = measured(frontier.join(state.select("qid", "node"), ["qid", "node"], "left_anti")).withColumn("open", F.lit(True))
        state = materialise(best(state.withColumn("open", F.lit(False)).unionByName(fresh), beam), f"beam-{i + 1}")
    return best(state.select("qid", "node", "s"), k)


def other_rows(found: DataFrame, held: DataFrame, k: int = 5) -> DataFrame:
    """``id, other, s``: the ``k`` best rows of the nodes found (``qid, node, s``; ``k + 1`` of them, as the query's own is one).

    The query's own row is left out; other rows with its vector are not.
    """
    few = _best(held.select("id", "node").distinct().join(found.select("node").distinct(), "node", "left_semi").withColumn("s", F.lit(1.0)), k + 1, "node", "id")
    rows = found.join(few.select("node", F.col("id").alias("other")), "node").select(F.col("qid").alias("id"), "other", "s").filter("id <> other")
    return _best(rows, k, "id", "other")
